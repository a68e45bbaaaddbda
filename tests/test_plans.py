"""Plan shape: payload never shuffled, stores broadcast, filters pushed to the scan."""

from assetsweep.operators import duplicates as D
from assetsweep.operators import inventory as I
from assetsweep.sources import tables

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    out = []
    node_text = df._jdf.queryExecution().executedPlan().treeString()
    for line in node_text.splitlines():
        if "Exchange" in line:
            out.append(line)
    return out


def test_payload_not_in_any_exchange(spark):
    fp = D.fingerprint_payloads(tables.documents_assets(spark, SF))
    d = D.find_duplicates(fp, 1)
    for df in (d.groups, d.members(), fp.groupBy("size", "hash").count()):
        for line in exchanges(df):
            assert "payload" not in line and "text" not in line, line


def test_group_aggregate_is_partial(spark):
    fp = D.fingerprint_payloads(tables.documents_assets(spark, SF))
    cands = fp.where("ok")
    g = cands.groupBy(*D.KEY).count()
    txt = g._jdf.queryExecution().executedPlan().treeString()
    assert "partial_count" in txt


def test_store_join_is_an_equi_join_for_any_number_of_roots(spark):
    stores = spark.range(3000).selectExpr("'k' as kind", "concat('https://h', id) as root").unionByName(
        spark.createDataFrame([("k", "https://")], "kind string, root string"))
    for boundary in (True, False):
        s = I.store_summaries(tables.pages_assets(spark, SF), stores, boundary=boundary)
        assert "NestedLoop" not in s._jdf.queryExecution().executedPlan().treeString()
        assert s.count() == 3001


def test_columns_pruned_and_filters_pushed(spark):
    a = tables.documents_assets(spark, SF).where("store = 'src1'").select("asset_id", "store")
    txt = a._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in txt
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in txt


PAYLOAD_COLUMNS = {"text", "payload", "html", "content", "json"}


def _node_names(node, out):
    out.append(node.nodeName())
    kids = node.children()
    for i in range(kids.size()):
        _node_names(kids.apply(i), out)
    return out


def test_no_cross_join_and_no_unpartitioned_window(spark):
    """No registered query plans a cartesian product; a nested-loop join appears only
    where every model meets every device (a table whose row count is checked); no
    window runs without a partition key except over the bounded top-k rows and
    over one row per partition (ranks)."""
    from assetsweep.plans import registry as E
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    windows = set()
    try:
        for name, fn in E.QUERIES.items():
            plan = fn(spark, SF)._jdf.queryExecution().executedPlan()
            names = _node_names(plan, [])
            assert "CartesianProduct" not in names, name
            if "BroadcastNestedLoopJoin" in names:
                assert name in ("capacity_fit", "capacity_header_context"), name
            if "Window" in names:
                windows.add(name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Beside the top-k rows these number rows by a running sum over one row per partition.
    assert windows <= {"top_assets", "dup_groups_top", "size_candidates_ranked", "inventory_report", "group_chunks"}


def _exchange_outputs(node, out):
    name = node.nodeName()
    if "Exchange" in name and "Broadcast" not in name:
        attrs = node.output()
        out.append((name, {attrs.apply(i).name() for i in range(attrs.size())}))
    kids = node.children()
    for i in range(kids.size()):
        _exchange_outputs(kids.apply(i), out)
    return out


def test_no_registered_query_shuffles_payload(spark):
    """With broadcasts off (the shape at scale), no Exchange of any registered
    query carries a text or payload column."""
    from assetsweep.plans import registry as E
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    seen = 0
    try:
        for name, fn in E.QUERIES.items():
            plan = fn(spark, SF)._jdf.queryExecution().executedPlan()
            for node, cols in _exchange_outputs(plan, []):
                seen += 1
                assert not (cols & PAYLOAD_COLUMNS), (name, node, cols)
        assert seen > 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
