from gridsift.sources.location import locate


def test_kinds():
    assert locate("a/b.csv").kind == "local"
    assert (locate("https://www.kdocs.cn/l/abc_1?x=1").kind, locate("https://www.kdocs.cn/l/abc_1?x=1").share_id) == ("share", "abc_1")
    for other in ("https://kdocs.cn/l/", "https://kdocs.cn/doc/abc", "http://example.org/l/abc", "https://notkdocs.cn/l/abc"):
        assert locate(other).kind == "remote"
    assert locate("http://files.example.org/l/z", ("example.org",)).share_id == "z"
