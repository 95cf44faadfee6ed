"""read_entries: a namespace that is declared after a long comment counts."""

from tessera.sources import watchlist


def test_namespace_after_long_comment(spark, tmp_path):
    at = tmp_path / "late.xml"
    at.write_text("<!-- " + "x" * 10_000 + ' -->\n<sdnList xmlns="http://lists.example.org/v1"><sdnEntry><uid>7</uid><lastName>A</lastName></sdnEntry></sdnList>')
    assert [r.uid for r in watchlist.read_entries(spark, str(at), "http://lists.example.org/v1").collect()] == [7]
    assert watchlist.read_entries(spark, str(at), "http://lists.example.org/v2").count() == 0
