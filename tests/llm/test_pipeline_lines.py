"""The pipeline's line stage on lines planted at small shares of a site."""

import corpus_pipeline


def test_planted_lines(spark):
    shares = (1, 2, 3, 5)
    planted = {s: f"This site is licensed under terms number {s}." for s in shares}
    rows = []
    for i in range(1000):
        lines = [f"Only page {i} of the whole site says so.", "Yes." if i % 20 == 0 else f"No {i}."]
        lines += [planted[s] for s in shares if i % 100 < s]
        rows.append((i, "site", "\n".join(lines)))
    few = "A line that only four pages of the site repeat."
    copied = "A page that was copied forty times, with nothing else of its own."
    rows = [(i, s, t + (f"\n{few}" if 500 <= i < 504 else "")) for i, s, t in rows]
    rows += [(2000 + i, "site", copied) for i in range(40)]
    rows += [(3000 + i, "other", f"{planted[1]}\nThe other site has page {i}.") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    gone = set(planted.values())
    for i, source, text in rows:
        want = text if source == "other" else "\n".join(x for x in text.split("\n") if x not in gone)
        assert left[i] == want
