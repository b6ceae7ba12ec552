"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_bytes
from .collocations import collocations
from .hilbert import hilbert_shards
from .kdtree import top_k
from .line_dedup import line_report
from .mixing import BINS, FORMS, LENGTHS, SPILL, mixture
from .ngram_join import similar_groups
from .pii import find_pii
from .quality import quality_report
from .runs import find_runs
from .substrings import drop_repeats
from .token_counts import section_tokens
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_and_pattern() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_report(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op2_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP2_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"), dims=["source", "lang", "n_chars"], n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = ranks_and_pattern()
    out = encode_bytes(table(spark, sf_dir, "documents"), ranks=ranks, pattern=pattern, offsets=True)
    # offsets_crc32: of the tokens' starts and then their ends, as the ids are written.
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.crc32(F.concat("starts", "ends")).alias("offsets_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = ranks_and_pattern()
    out = section_tokens(table(spark, sf_dir, "documents"), fields=["source", "lang", "text"], by_line={"text"}, ranks=ranks, pattern=pattern, rule="start")
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


#: Target shares of languages; those of sources and topics are their own, raised to 0.9.
OP9_TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"), power=0.9, targets=OP9_TARGETS)
    return out.withColumn("probability", F.round("probability", 6))


def _topic_sql() -> str:
    size, n = "strlen(t)", "length(t)"
    score = lambda signs, least: "(" + " + ".join(f"CAST({size} - strlen(replace(t, {_sign(x)}, '')) AS DOUBLE)" for x in signs) + f") * CAST(1000 AS DOUBLE) / (greatest({size}, 1) * CAST({least} AS DOUBLE))"
    scores = [score(signs, least) for signs, least in FORMS.values()]
    top = f"greatest({', '.join(scores)})"
    forms = " ".join(f"WHEN {top} >= 1 AND {x} = {top} THEN '{name}'" for name, x in zip(FORMS, scores))
    return f"CASE {forms} {' '.join(f'WHEN {n} < {below} THEN {chr(39)}{name}{chr(39)}' for name, below in LENGTHS)} ELSE 'book' END"


def _sign(x: str) -> str:
    return f"chr({ord(x)})" if x in "\t\n" else f"'{x}'"


def _op9_sql(rounds: int, power: float, targets: dict[str, dict[str, float]], seed: int) -> str:
    dims = ("source", "lang", "topic")
    shares = []
    for d in dims:
        named = targets.get(d, {})
        weight = " ".join(f"WHEN '{v}' THEN CAST({w} AS DOUBLE)" for v, w in named.items())
        rest = max(0.0, 1.0 - sum(named.values())) if named else 1.0
        shares.append(
            f"v_{d} AS (SELECT {d}, sum(tokens) AS own, {f'CASE {d} {weight} END' if named else 'CAST(NULL AS DOUBLE)'} AS weight, pow(sum(tokens), CAST({power} AS DOUBLE)) AS raised FROM cells GROUP BY {d}),"
            f" s_{d} AS (SELECT sum(own) AS total, coalesce(sum(weight), 0) AS present, coalesce(sum(raised) FILTER (WHERE weight IS NULL), 0) AS others FROM v_{d}),"
            f" t_{d} AS (SELECT {d}, coalesce(weight, CAST({rest} AS DOUBLE) * raised / others) * total / (present + CASE WHEN others > 0 THEN CAST({rest} AS DOUBLE) ELSE 0 END) AS target_{d} FROM v_{d}, s_{d})"
        )
    steps, last = [], "f0"
    for k in range(rounds * 3):
        d, name = dims[k % 3], f"f{k + 1}"
        has = f"sum(tokens * factor) OVER (PARTITION BY {d})"
        steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {has} > 0 THEN factor * target_{d} / {has} ELSE factor END AS factor) FROM {last})")
        last = name
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_topic_sql()} AS topic,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
{", ".join(shares)},
f0 AS MATERIALIZED (SELECT source, lang, topic, tokens, target_source, target_lang, target_topic, 1.0::DOUBLE AS factor FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{", ".join(steps)},
bins AS (SELECT floor(log2(factor) * {BINS}) AS bin, sum(tokens) AS tokens FROM {last} WHERE tokens > 0 AND factor > 0 GROUP BY 1),
above AS (SELECT bin, sum(tokens) OVER (ORDER BY bin DESC) AS above, sum(tokens) OVER () AS total FROM bins),
scale AS (SELECT pow(CAST(2 AS DOUBLE), (max(bin) + 1) / {BINS}) AS scale FROM above WHERE above > {SPILL} * total),
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1, factor / scale) ELSE 1.0 END AS probability FROM {last}, scale)
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability,
       CAST(concat('0x', substr(md5(concat(doc_id, ':{seed}')), 1, 13)) AS BIGINT) / 4503599627370496.0 < probability AS selected
FROM docs JOIN p USING (source, lang, topic)
"""


#: So many rounds bring every marginal to its target as nearly as mixture()'s tolerance asks for; more change nothing that shows.
OP9_SQL = _op9_sql(20, 0.9, OP9_TARGETS, 17)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "pages"))
    return out.select(
        F.col("main.page_id").alias("page_id"),
        F.coalesce("main.bytes", "referred.bytes").alias("payload_bytes"),
        F.coalesce(F.when(F.col("main.kind") == "revisit", F.col("referred.digest")), F.col("main.digest")).alias("payload_digest"),
        F.col("main.kind").alias("record_type"),
        F.col("referred.page_id").alias("refers_to"),
    )


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), {_UPPER}), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents),
found AS (
  SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 5) t(m))),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM found GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.words = c.k AND x.phrase = array_to_string(c.w[1:c.k], ' ')
       JOIN f y ON y.lang = c.lang AND y.words = c.words - c.k AND y.phrase = array_to_string(c.w[c.k + 1:c.words], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM candidates, range(2, 4) t(m) WHERE m < words) GROUP BY ALL),
stay AS (SELECT s.* FROM lowest s LEFT JOIN inner_ i USING (lang, phrase) WHERE i.around IS NULL OR 100 * i.around < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM stay JOIN total USING (lang) QUALIFY rank <= 2000
"""


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rule of op12 by which every tenth document repeats a part of itself to its end; a null id counts as none of them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), min_words=12, alter=looped)
    # The greatest length; of equals the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("-(1000 * longest.length div longest.period)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"), words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"), "longest")


def _op13_sql(words: int, levels: int) -> str:
    """The levels double as the operator's do: a window of twice the length is known by its halves."""
    steps = [f"w0 AS MATERIALIZED (SELECT doc_id, i AS start, md5(array_to_string(w[i:i + {words - 1}], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words} + 2)) AS i FROM d))"]
    for k in range(1, levels):
        steps.append(f"w{k} AS MATERIALIZED (SELECT a.doc_id, a.start, md5(a.key || b.key) AS key FROM w{k - 1} a JOIN w{k - 1} b ON a.doc_id = b.doc_id AND b.start = a.start + {words << (k - 1)})")
    common = " UNION ALL ".join(f"SELECT doc_id, {words << k} AS longest FROM w{k} WHERE key IN (SELECT key FROM w{k} GROUP BY key HAVING count(DISTINCT doc_id) > 1)" for k in range(levels))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
{", ".join(steps)},
first AS (SELECT key, min(doc_id) AS first FROM w0 GROUP BY key),
gone AS (SELECT DISTINCT doc_id, start + k AS pos FROM w0 JOIN first USING (key), range({words}) t(k) WHERE first < doc_id),
stay AS (SELECT doc_id, i AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM stay ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT follows) AS n_spans FROM (SELECT doc_id, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = pos - 1, false) AS follows FROM gone) GROUP BY doc_id),
long AS (SELECT doc_id, max(longest) AS longest FROM ({common}) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN long USING (doc_id)
"""


OP13_SQL = _op13_sql(13, 12)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_kdtree_top_k": op2_kdtree_top_k,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op2_kdtree_top_k": OP2_SQL, "op9_mixing": OP9_SQL, "op10_warc": OP10_SQL, "op11_collocations": OP11_SQL, "op13_substring_dedup": OP13_SQL}
