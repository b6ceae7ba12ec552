"""Personal data and secrets: regular expressions propose spans, checksums and entropy confirm them, words nearby move their score.

All of it is SQL functions. A text is split at a pattern and the pattern's matches are extracted; the lengths of both, summed in
order, are the spans. The sums run over rows of (document, kind), so a text with very many matches costs no more for each. Only
what lies around a match, never the text, is shuffled. Patterns are possessive, and those that begin with a run start only
where the run does, so that long runs cost linear time and no recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import BROADCAST_ROWS, ascii_lower, hidden, position, restored, stored

#: Code points before and after a match in which context words count.
BEFORE, AFTER = 40, 20
KEEP = 0.6

# Patterns of the base kinds (e-mail, address, card number, phone number), made possessive.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
#: Opaque words: a run of the letters of hex, base64 and identifiers, from 16 to 512 of them; longer runs are data, not keys.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,512}+={0,2}(?![A-Za-z0-9+/_-])"
# Forms of keys that issuers mark.
MARKED = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
PASSWORD = r"(?i)(?<![a-z0-9])(?:password|passwd|passphrase|passwort|kennwort|contraseña)[\"']?[ ]?[:=][ ]?[\"']?[^\s\"',;<>]{6,64}"
#: Bits for each sign that a secret has at least.
ENTROPY = 3.0


@dataclass(frozen=True)
class Kind:
    """prior: score of a confirmed match. words: context that adds `boost`. may: a cheap sign without which a text has no match."""

    name: str
    pattern: str
    base: bool
    prior: float
    boost: float
    words: str
    may: str


KINDS = (
    Kind("email", EMAIL, True, 0.9, 0.1, r"\b(?:mail|e-mail|contact|correo|courriel)\b", "@"),
    Kind("ip", IP, True, 0.7, 0.2, r"\b(?:ip|host|server|address|adresse|adresa)\b", r"[0-9]\.[0-9]"),
    Kind("card", CARD, True, 0.8, 0.2, r"\b(?:card|visa|mastercard|credit|carte|tarjeta|karte)\b", r"[0-9](?:[ -]?[0-9]){12}"),
    Kind("phone", PHONE, True, 0.8, 0.2, r"\b(?:phone|tel|mobile|call|fax|telefon|telefono|portable)\b", r"\+[0-9]"),
    Kind("iban", IBAN, False, 0.9, 0.1, r"\b(?:iban|account|konto|compte|cuenta)\b", r"[A-Z]{2}[0-9]{2}"),
    Kind("shortcard", CARD, False, 0.3, 0.4, r"\b(?:card|amex|diners|maestro|credit|carte|tarjeta|karte)\b", r"[0-9](?:[ -]?[0-9]){12}"),
    Kind("ssn", SSN, False, 0.4, 0.4, r"\b(?:ssn|social security)\b", r"[0-9]-[0-9]{2}-[0-9]"),
    Kind("secret", OPAQUE, False, 0.3, 0.5, r"(?:\b|_)(?:token|secret|key|apikey|api_key|auth|authorization|bearer|credential|credentials|password|jwt|sig|signature|schlüssel|clave|clé)\b", r"[A-Za-z0-9+/_-]{16}"),
    Kind("apikey", MARKED, False, 0.9, 0.1, r"\b(?:token|secret|key|auth)\b", r"AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|-----BEGIN "),
    Kind("password", PASSWORD, False, 0.8, 0.2, r"\b(?:login|user|account|konto)\b", r"(?i)pass|kennwort|contrase"),
)


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + v - 9 * (v > 9).cast("int")) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (letters and digits, check digits third and fourth) leaves 1 when taken as a number modulo 97."""
    turned = F.split(F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4)), "")
    value = lambda c: F.ascii(c) - F.when(c < "A", 48).otherwise(55)
    return F.aggregate(turned, F.lit(0), lambda s, c: (s * F.when(c < "A", 10).otherwise(100) + value(c)) % 97) == 1


def entropy(text: Column) -> Column:
    """Bits for each character of a text, by how often each of its characters occurs."""
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.coalesce(share(c) * F.log2(share(c)), F.lit(0.0)))


def _confirmed(kind: Column, match: Column) -> Column:
    digits = F.translate(match, "+ ().-", "")
    n = F.char_length(digits)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    code = F.translate(match, " ", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", n.between(16, 19) & luhn(digits))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "iban", F.char_length(code).between(15, 34) & mod97(code))
        .when(kind == "shortcard", n.between(13, 15) & luhn(digits))
        .when(kind == "secret", match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (entropy(match) >= ENTROPY))
        .when(kind.isin("apikey", "password"), True)
        .otherwise(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))
    )


def _proposed(text: Column, kind: Kind) -> Column:
    """An array of the kind's matches in a text: kind, k, skipped (code points since the last match), match; and by what context is put together:
    before and after (the ends of the parts beside the match), tail (of part and match), head (of match and next part)."""
    parts, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    zipped = F.arrays_zip(matches.alias("m"), parts.alias("p"), F.slice(parts, F.lit(2), F.size(parts)).alias("q"))
    found = F.transform(
        zipped,
        lambda x, k: F.struct(
            F.lit(kind.name).alias("kind"),
            k.alias("k"),
            F.char_length(x["p"]).alias("skipped"),
            x["m"].alias("match"),
            F.right(x["p"], F.lit(BEFORE)).alias("before"),
            F.left(x["q"], F.lit(AFTER)).alias("after"),
            F.right(F.concat(F.right(x["p"], F.lit(BEFORE)), F.right(x["m"], F.lit(BEFORE))), F.lit(BEFORE)).alias("tail"),
            F.left(F.concat(F.left(x["m"], F.lit(AFTER)), F.left(x["q"], F.lit(AFTER))), F.lit(AFTER)).alias("head"),
        ),
    )
    may = F.contains(text, F.lit("@")) if kind.may == "@" else text.rlike(kind.may)
    return F.when(may, found).otherwise(F.array())


def _spans(src: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """For src (row, id, text): row, id, kind_no, start, end, kind, base, score, stays; a row whose text has no match has one line that does not stay."""
    items = src.select("row", "id", F.explode_outer(F.concat(*[_proposed(F.col("text"), k) for k in kinds])).alias("x")).select("row", "id", "x.*")
    order = W.Window.partitionBy("row", "kind").orderBy("k").rowsBetween(W.Window.unboundedPreceding, 0)
    end = F.sum(F.col("skipped") + F.char_length("match")).over(order)
    # Context runs on over neighbouring matches. None is empty, so those of so many rows fill it.
    rows = W.Window.partitionBy("row", "kind").orderBy("k")
    joined = lambda piece, a, b: F.array_join(F.collect_list(F.coalesce(F.col(piece), F.lit(""))).over(rows.rowsBetween(a, b)), "")
    before = F.right(F.concat(joined("tail", -BEFORE, -1), F.col("before")), F.lit(BEFORE))
    after = F.left(F.concat(F.col("after"), joined("head", 1, AFTER)), F.lit(AFTER))
    near = F.concat(F.col("near_before"), F.lit(" "), F.col("near_after"))
    score, number, base = F.lit(None), F.lit(None), F.lit(None)
    for i, k in enumerate(kinds):
        is_kind = F.col("kind") == k.name
        score = F.when(is_kind, k.prior + k.boost * ascii_lower(near).rlike(k.words).cast("double")).otherwise(score)
        number, base = F.when(is_kind, i).otherwise(number), F.when(is_kind, k.base).otherwise(base)
    return (
        items.repartition("row")
        .withColumns({"end": end, "near_before": before, "near_after": after})
        .withColumns({"score": score, "kind_no": number, "base": base})
        .withColumn("stays", F.col("match").isNotNull() & (F.col("base") | (F.col("score") >= KEEP)) & _confirmed(F.col("kind"), F.col("match")))
        .withColumn("start", F.col("end") - F.char_length("match"))
    )


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """id and spans of each row of docs: an array of (kind_no, start, end, kind, base, score), by kind as in kinds and then by start.

    Spans are code points of the text, end exclusive; matches of one kind do not overlap, those of several may. Matches of base
    kinds that their check confirms always stay; others stay if their score, moved by context words, reaches KEEP.
    Null text counts as empty. Repeated rows, and rows with a null id, each give a row; an empty table gives an empty result; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    span = F.struct("kind_no", "start", "end", "kind", "base", "score")
    out = _spans(src, kinds).groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("stays"), span))).alias("spans"))
    return out.select(F.col("id").alias(id_col), "spans")


def redact(docs: DataFrame, *, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span of find_pii() in the text replaced by its kind in brackets, all else as it was.

    Spans that overlap become one, named by the one that starts first, so nothing of either is left. Rows are told apart by a number that is stored with
    them, so null and repeated ids and repeated rows do no harm. A null text stays null; an empty table gives an empty result; extra columns stay.
    """
    src = hidden(docs)
    text = position(docs, text_col)
    src = stored(src.withColumn("row", F.monotonically_increasing_id()), "to-redact")
    found = _spans(src.select("row", F.lit(0).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), kinds).filter("stays")
    order = W.Window.partitionBy("row").orderBy("start", F.desc("end"), "kind_no").rowsBetween(W.Window.unboundedPreceding, -1)
    found = found.withColumn("upto", F.coalesce(F.max("end").over(order), F.lit(0)))
    cut = F.struct("start", "upto", "kind")
    cuts = stored(found.groupBy("row").agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("end").alias("last")).withColumnRenamed("row", "cut_row"), "cuts")
    few = cuts.count() <= BROADCAST_ROWS
    both = src.join(F.broadcast(cuts) if few else cuts, F.col("row") == F.col("cut_row"), "left")
    part = lambda a, b: F.substr(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform("cuts", lambda c: F.when(c["start"] >= c["upto"], F.concat(part(c["upto"], c["start"]), F.lit("["), c["kind"], F.lit("]"))).otherwise(F.lit("")))
    done = F.concat(F.array_join(pieces, ""), part(F.col("last"), F.char_length(text)))
    return restored(both.withColumn("redacted", F.when(F.col("cuts").isNull(), F.col(text)).otherwise(done)), docs, {text: "redacted"})
