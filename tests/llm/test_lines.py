from pyspark.sql import functions as F

from strataloom.llm import line_dedup


def test_very_long_texts_take_time_in_proportion(spark):
    """Half a million lines in a document, each lost but in the last: far out of reach if each were looked up in a list."""
    n = 500_000
    text = "\n".join(f"this is the line number {i} of it" for i in range(n))
    rows = line_dedup.dedup_lines(spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string"))
    got = rows.select("doc_id", "n_lines", "n_dropped", F.length("kept").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [(0, n, n, 0), (1, n, n, 0), (2, n, 0, len(text))]


def test_rows_of_one_id_keep_their_own_lines(spark):
    often = "a line that is found in many documents"
    rows = [(1, f"x\n{often}"), (1, f"{often}\ny\n{often}"), (2, f"{often}\nz"), (3, often), (None, often)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["kept"], r["n_dropped"]) for r in got) == [(0, often, 0), (1, "x", 1), (1, "y", 2), (2, "z", 1), (3, often, 0)]


def test_the_anti_join_carries_the_counts(spark, monkeypatch):
    """Each line is in one run alone; without the anti-join the lines of several batches would be counted wrongly."""
    batches = [[(b * 10 + i, line, 0) for i in range(3) for line in (1, 2 + b, 9 if b % 2 else 8)] for b in range(5)]
    rows = [spark.createDataFrame(b, "doc_id long, h1 long, h2 long") for b in batches]
    want = {}
    for d, line, _ in sum(batches, []):
        n, top = want.get(line, (0, 0))
        want[line] = (n + 1, max(top, d))

    def counted():
        runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
        try:
            for b in rows:
                runs.add(b)
            places = [r["h1"] for name in runs.runs() for r in spark.table(name).collect()]
            return {r["h1"]: (r["n_docs"], r["max_doc"]) for r in runs.known().collect()}, places
        finally:
            runs.drop()

    got, places = counted()
    assert got == want and sorted(places) == sorted(want)
    monkeypatch.setattr(line_dedup.LineRuns, "fresh", lambda self, batch: batch)
    assert counted()[0] != want
