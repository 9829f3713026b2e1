from collections import Counter

from lumenact.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, ratio, min_pages):
    hosts = Counter(h for _, h, _ in rows)
    seen = Counter()
    for _, h, t in rows:
        seen.update({(h, x.strip(WHITE)) for x in (t or "").split("\n")} - {(h, "")})
    out = []
    for i, h, t in rows:
        lines = (t or "").split("\n")
        bad = [hosts[h] >= min_pages and seen[h, x.strip(WHITE)] > max(1, ratio * hosts[h]) for x in lines]
        left = None if t is None else "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)
        out.append((i, h, left, sum(bad) if t is not None else 0))
    return Counter(out)


def test_against_brute_force(spark):
    rows = [(i, "busy" if i % 3 else "quiet", f"menu\n own line {i} \n\n  footer\t\nend{i % 4}") for i in range(60)]
    rows += [(100 + i, "tiny", "menu\nfooter") for i in range(3)] + [(200, None, "menu\nx"), (201, None, None), (202, "busy", None), (203, "busy", "")]
    rows += [(300 + i, None, "menu\n menu") for i in range(6)] + [(1, "busy", "menu\nmenu\nmenu")] * 2
    df = spark.createDataFrame(rows, "doc_id long, _host string, text string")
    for ratio, least in ((0.3, 5), (0.05, 2), (0.9, 5)):
        got = Counter(tuple(r) for r in line_dedup.without_boilerplate(df, "_host", "text", ratio, least).collect())
        assert got == brute(rows, ratio, least)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, host string, text string")
    assert line_dedup.without_boilerplate(df, "host").count() == 0


def test_hosts(spark):
    urls = ["https://www.Example.com:80/a?b", "http://user@x.org/www.y", "no url", None, "https://a.b"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in rows.select(line_dedup.host_of(rows.url)).collect()] == ["example.com", "x.org", "", None, "a.b"]
