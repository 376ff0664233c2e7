"""Shared pieces: components of few edges in few tasks, and rows left out without a shuffle of what they hold."""

from opsledger.llm import bloom, common


def test_few_edges_make_few_files(spark, monkeypatch):
    """Where shuffles have many partitions that nothing coalesces, rounds over few edges don't have as many tasks."""
    parts, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: (parts.append((out := cut(df)).rdd.getNumPartitions()), out)[1])
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "a bigint, b bigint")
        got = dict(map(tuple, common.connected_components(edges, "a", "b").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert len(parts) > 2 and max(parts[1:]) <= 8


def test_rows_left_out_by_a_filter_do_not_shuffle(spark, monkeypatch):
    """With more keys than a broadcast takes, and most rows gone, only keys meet; false hits of the filter stay."""
    marked = bloom.small
    monkeypatch.setattr(bloom, "small", lambda df, size: df if df.columns == ["gone"] else marked(df, size))
    monkeypatch.setattr(bloom, "pieces_for", lambda rows: 1)  # a full filter lets many through that aren't gone
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = spark.range(30_000).selectExpr("id AS k", "cast(id AS string) AS text").unionByName(spark.range(5).selectExpr("id AS k", "'again' AS text"))
    out = bloom.without(docs, "k", spark.range(0, 30_000, 3).toDF("r"))
    try:
        plan, got = out._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(k#" not in plan
    assert got == sorted([(i, str(i)) for i in range(30_000) if i % 3] + [(i, "again") for i in range(5) if i % 3])
