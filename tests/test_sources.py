"""Loading, landing, ledger and the full build on small files."""

import random
from datetime import datetime
from pathlib import Path

import pytest

from tradewind.operators import catalog, quality, vectors
from tradewind.plans.build_all import FailedChecksError, build_all
from tradewind.plans.kpis import dashboard
from tradewind.sources import landing, raw, records, tables
from tradewind.sources.ledger import RunLedger
from tradewind.sources.specs import SOURCES

SPEC = {spec.table: spec for spec in SOURCES}


def write(path: Path, text: str, encoding: str = "utf-8") -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path


def test_nine_sources():
    assert len(SOURCES) == 9
    assert len({spec.table for spec in SOURCES}) == 9


def test_byte_order_mark_and_cells(spark, tmp_path):
    write(
        tmp_path / "x_sellers_dataset.csv",
        'seller_id,seller_zip_code_prefix,seller_city,seller_state\r\n'
        'a,01,"rio, centro",RJ\r\n'
        'b,"","say ""hi""\nthere",\r\n',
        "utf-8-sig",
    )
    rows = raw.read_raw(spark, SPEC["sellers"], str(tmp_path), "x_", multiline=True)
    rows = rows.orderBy("seller_id").collect()
    assert [tuple(r) for r in rows] == [
        ("a", "01", "rio, centro", "RJ"),
        ("b", "", 'say "hi"\nthere', None),
    ]


def test_ragged_row_fails(spark, tmp_path):
    write(
        tmp_path / "product_category_name_translation.csv",
        "product_category_name,product_category_name_english\na,b\nonly\n",
    )
    with pytest.raises(Exception, match="MALFORMED"):
        raw.read_raw(spark, SPEC["product_category_translation"], str(tmp_path)).collect()


def test_header_names_are_checked_on_request(spark, tmp_path):
    write(tmp_path / "product_category_name_translation.csv", "first,second\na,b\n")
    spec = SPEC["product_category_translation"]
    with pytest.raises(Exception, match="header"):
        raw.read_raw(spark, spec, str(tmp_path)).collect()
    rows = raw.read_raw(spark, spec, str(tmp_path), check_header=False).collect()
    assert [tuple(r) for r in rows] == [("a", "b")]


def test_spanning_records_are_found(spark, tmp_path):
    flat = write(tmp_path / "flat.csv", 'a,b\n"x, ""q""",1\n"",2\n')
    spanning = write(tmp_path / "spanning.csv", 'a,b\n"x\ny",1\n')
    assert not raw.has_spanning_records(spark, str(flat))
    assert raw.has_spanning_records(spark, str(spanning))


def test_spanning_records_must_be_declared(spark, tmp_path):
    header = "product_category_name,product_category_name_english\n"
    spec = SPEC["product_category_translation"]
    write(tmp_path / "a" / spec.file_name, header + "x,y\nz,w\n")
    write(tmp_path / "b" / spec.file_name, header + '"x\nx",y\nz,w\n')
    assert raw.read_raw(spark, spec, str(tmp_path / "a")).count() == 2
    with pytest.raises(ValueError, match="multiline"):
        raw.read_raw(spark, spec, str(tmp_path / "b"))
    rows = raw.read_raw(spark, spec, str(tmp_path / "b"), multiline=True).collect()
    assert sorted(tuple(r) for r in rows) == [("x\nx", "y"), ("z", "w")]
    assert [name for name, s in SPEC.items() if s.multiline] == ["order_reviews"]


def test_split_files_skip_the_byte_order_mark(spark, tmp_path):
    spec = SPEC["product_category_translation"]
    text = ",".join(spec.columns) + "\r\nx,\r\n\"\",\"a,b\"\r\n"
    write(Path(spec.path(str(tmp_path))), text, "utf-8-sig")
    rows = raw.read_raw(spark, spec, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("x", None), ("", "a,b")]


def test_a_folder_of_parts_is_one_source(spark, tmp_path):
    spec = SPEC["product_category_translation"]
    for part in ("one.csv", "two.csv"):
        write(Path(spec.path(str(tmp_path))) / part, ",".join(spec.columns) + f"\n{part},y\n")
    rows = raw.read_raw(spark, spec, str(tmp_path)).collect()
    assert sorted(r[0] for r in rows) == ["one.csv", "two.csv"]


def test_missing_file_marks_the_run_failed(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="customers_dataset.csv"):
        raw.load_all(spark, str(tmp_path))
    runs = RunLedger(spark).runs().where("status = 'failed'").collect()
    assert len(runs) == 1
    assert "customers_dataset.csv" in runs[0].error_message
    assert runs[0].finished_at >= runs[0].started_at and runs[0].duration_seconds >= 0


def test_ledger_keeps_long_errors(spark):
    tables.ensure_namespaces(spark)
    ledger = RunLedger(spark, "raw.other_events")
    first, second = ledger.start(), ledger.start()
    ledger.finish(first, "failed", 1.2349, "e" * 3000)
    rows = {r.run_id: r for r in ledger.runs().collect()}
    assert rows[first].status == "failed" and rows[first].error_message == "e" * 3000
    assert str(rows[first].duration_seconds) == "1.23"
    assert rows[second].status == "running" and rows[second].finished_at is None


@pytest.mark.parametrize(
    "name, wanted",
    [("My File (1)", "my_file_1"), ("__A__", "a"), ("çã", "data"), ("x" * 80, "x" * 60), ("", "data")],
)
def test_slug(name, wanted):
    assert landing.slug(name) == wanted


def test_landing(spark, tmp_path):
    path = write(
        tmp_path / "Sales 2018.csv",
        'Order ID,Total $,note\n1,2.5,"a\nb"\n2,,\n3,4\n5,6,7,8\n',
        "utf-8-sig",
    )
    path.write_bytes(path.read_bytes() + b"9,caf\xe9,x\n")
    landed = landing.land_csv(spark, str(path), datetime(2024, 5, 6, 7, 8, 9))
    assert landed.table == "uploads.sales_2018_20240506_070809"
    assert landed.columns == ["order_id", "total", "note"]
    assert landed.rows_loaded == 5
    rows = sorted(tuple(r) for r in spark.table(landed.table).fillna("NULL").collect())
    assert rows == [
        ("1", "2.5", "a\nb"), ("2", "", ""), ("3", "4", "NULL"), ("5", "6", "7"),
        ("9", "caf�", "x"),
    ]


def test_landing_keeps_every_row(spark, tmp_path):
    path = write(tmp_path / "u.csv", "n\n" + "\n".join(str(i) for i in range(60_000)) + "\n")
    for multiline in (True, False):
        rows = landing.read_upload(spark, str(path), multiline)
        assert rows.selectExpr("count(distinct n)", "sum(n)").first() == (60_000, 60_000 * 59_999 / 2)


def test_landing_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot name"):
        landing.read_upload(spark, str(write(tmp_path / "a.csv", "2018,b\n1,2\n")))
    with pytest.raises(ValueError, match="not distinct"):
        landing.read_upload(spark, str(write(tmp_path / "b.csv", "a b,a-b\n1,2\n")))
    with pytest.raises(ValueError, match="CSV text"):
        landing.read_upload(spark, str(write(tmp_path / "c.pdf", "a\n1\n")))
    with pytest.raises(FileNotFoundError):
        landing.read_upload(spark, str(tmp_path / "none.csv"))


def test_a_failed_write_leaves_the_old_content(spark):
    tables.ensure_namespaces(spark)
    tables.materialize(spark.range(3), "raw.kept")
    open_reader = spark.table("raw.kept")
    bad = spark.range(100).selectExpr("id", "if(id = 77, raise_error('no'), 1) AS v")
    with pytest.raises(Exception, match="no"):
        tables.materialize(bad.repartition(4), "raw.kept")
    assert spark.table("raw.kept").count() == 3
    tables.materialize(spark.range(9), "raw.kept")
    assert open_reader.count() == 3 and spark.table("raw.kept").count() == 9


def test_a_table_of_the_same_name_is_replaced(spark):
    tables.ensure_namespaces(spark)
    spark.range(4).write.saveAsTable("raw.was_table")
    assert tables.materialize(spark.range(6), "raw.was_table").count() == 6


def test_a_failed_write_does_not_block_the_next(spark):
    tables.ensure_namespaces(spark)
    bad = spark.range(100).selectExpr("id", "if(id = 77, raise_error('no'), 1) AS v")
    with pytest.raises(Exception, match="no"):
        tables.materialize(bad.repartition(4), "raw.second_try")
    good = tables.materialize(spark.range(5), "raw.second_try")
    assert sorted(r.id for r in good.collect()) == [0, 1, 2, 3, 4]
    assert tables.materialize(spark.range(2), "raw.second_try").count() == 2


def test_curated_layers_only(spark):
    with pytest.raises(PermissionError):
        tables.read_curated(spark, "raw.orders")
    with pytest.raises(PermissionError):
        tables.read_curated(spark, "kpi_overview")


def test_bound_parameters(spark):
    rows = tables.run_query(
        spark, "SELECT id FROM range(10) WHERE id >= :low LIMIT :n", low=7, n=2
    ).collect()
    assert len(rows) == 2 and all(r.id >= 7 for r in rows)


@pytest.fixture(scope="module")
def delivery(tmp_path_factory):
    """Nine source files with one order of two items."""
    base = tmp_path_factory.mktemp("delivery")
    cells = {
        "customers": "c1,u1,01000,Sao Paulo,sp\n",
        "geolocation": "01000,-23.5,-46.6,sao paulo,SP\n",
        "order_items": "o1,1,p1,s1,2018-08-05 00:00:00,10.00,1.00\n"
        "o1,2,p1,s1,2018-08-05 00:00:00,20.00,2.00\n",
        "order_payments": "o1,1,card,1,33.00\n",
        "order_reviews": 'r1,o1,5,,"good,\nvery",2018-08-20 00:00:00,2018-08-21 00:00:00\n',
        "orders": "o1,c1,delivered,2018-08-01 10:00:00,2018-08-01 11:00:00,2018-08-02 00:00:00,"
        "2018-08-09 00:00:00,2018-08-12 00:00:00\n",
        "products": "p1,artes,5,6,1,100,1,2,3\n",
        "sellers": "s1,01000,Rio,rj\n",
        "product_category_translation": "artes,art\n",
    }
    for spec in SOURCES:
        write(Path(spec.path(str(base), "d_")), ",".join(spec.columns) + "\n" + cells[spec.table])
    return base


def test_full_build(spark, delivery):
    build = build_all(spark, str(delivery), "d_")
    report = {r.check_name: r for r in build.checks.collect()}
    assert len(report) == len(quality.STAGING_CHECKS) + len(quality.MART_CHECKS) + 2
    assert all(r.status == "pass" and r.failures == 0 for r in report.values())

    ledger = RunLedger(spark)
    run = ledger.runs().where(f"run_id = '{build.run_id}'").collect()[0]
    assert run.status == "success"
    counts = ledger.tables().where(f"run_id = '{build.run_id}'").collect()
    assert len(counts) == 9 and {r.table_name: r.row_count for r in counts}["order_items"] == 2

    overview = tables.read_curated(spark, "serving.kpi_overview").collect()[0]
    assert str(overview.gmv) == "33.00" and overview.total_orders == 1
    index = spark.table("marts.schema_index")
    assert index.where("fully_qualified = 'staging.stg_orders'").count() == 1
    assert "- order_id (string)" in index.where("table_name = 'fct_orders'").collect()[0].document
    assert spark.table("marts.glossary_index").count() == 4

    hits = vectors.retrieve(
        spark.table("marts.glossary_index"), ["gross merchandise value", "delay in days"],
        vectors.HashingProvider(), 2, payload=["key", "document"],
    )
    assert {r.query_id: r.key for r in hits.where("rank = 1").collect()} == {
        "gross merchandise value": "gmv", "delay in days": "delivery_delay_days"}
    assert vectors.pack_context(hits).count() == 2

    board = dashboard(spark, "2018-08-01", None, 5)
    assert board.warnings == []
    assert board.summary.series_row_count.collect()[0][0] == 1
    assert board.top_categories.collect()[0].category_name_en == "art"

    found = catalog.search_schema(catalog.column_inventory(spark), "GMV").collect()
    assert {(r.table_schema, r.table_name) for r in found} == {
        ("marts", "kpi_monthly_sales"), ("marts", "kpi_overview"),
        ("serving", "kpi_monthly_sales"), ("serving", "kpi_overview"),
    }


def test_month_filter_reads_few_partitions(spark, delivery):
    orders = spark.table("marts.fct_orders").where("order_month = DATE'2018-08-01'")
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan


def test_missing_category_table_is_a_warning(spark, delivery):
    spark.sql("DROP VIEW serving.fct_sales_by_category")
    with pytest.raises(tables.IncompleteLayerError, match="serving.fct_sales_by_category"):
        tables.require_objects(spark)
    board = dashboard(spark)
    assert board.top_categories is None and len(board.warnings) == 1
    tables.publish_serving(spark)
    tables.require_objects(spark)


def test_failed_check_stops_the_build(spark, delivery, tmp_path):
    for path in delivery.iterdir():
        write(tmp_path / path.name, path.read_text())
    before = spark.table("marts.fct_orders").collect()
    orders = tmp_path / "d_orders_dataset.csv"
    write(orders, orders.read_text().replace(",c1,", ",c404,").replace("2018-08-0", "2018-07-0"))
    with pytest.raises(FailedChecksError) as error:
        build_all(spark, str(tmp_path), "d_")
    assert "relationship_stg_orders_customer_id_to_stg_customers" in str(error.value)
    assert "raw_recency" in str(error.value)
    assert spark.table("marts.fct_orders").collect() == before


def as_csv(rows, rng, end):
    def cell(value):
        if value is None:
            return ""
        plain = value and not set(value) & set(',"\n') and rng.random() < 0.5
        return value if plain else '"' + value.replace('"', '""') + '"'

    return "".join(",".join(map(cell, row)) + end for row in rows)


@pytest.mark.parametrize("split", ["60", "700", "100m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_found_in_splits_of_any_size(spark, tmp_path, split, end):
    """Cells with line ends, quotes and commas, one of them over many splits."""
    rng = random.Random(int(split.rstrip("m")) + len(end))
    texts = ["x", "", None, "a\nb", 'say "hi"', '"', '""\n,"', "\n\n", "é, ü", " pad ", '"\n"']
    rows = [(f"r{i:04d}", rng.choice(texts), rng.choice(texts)) for i in range(400)]
    rows[150] = ("r0150", "line\n" * 400, 'quoted "line"\n' * 100)
    rows.append(("last", "no line end\nat the end", None))
    for name, part in (("one.csv", rows[:300]), ("two.csv", rows[300:])):
        text = as_csv([("id", "first", "second"), *part], rng, end)
        write(tmp_path / "up.csv" / name, text.removesuffix(end), "utf-8-sig" if name == "one.csv" else "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = landing.read_upload(spark, str(tmp_path / "up.csv"))
        if split == "60":
            assert spark.read.text(str(tmp_path / "up.csv")).rdd.getNumPartitions() > 50
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256m")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(tuple(v or "" for v in row) for row in rows)


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_records_lie_over_blocks(spark, tmp_path, monkeypatch, bits):
    """Splits of many blocks, and records that end with a block, go over it or fill some."""
    monkeypatch.setattr(records, "BLOCK_BITS", bits)
    rows = [(f"r{i:03d}", "x\n" * (i % 8), 'a "b"' if i % 3 else None) for i in range(300)]
    for name, part in (("one.csv", rows[:100]), ("two.csv", rows[100:])):
        write(tmp_path / "up.csv" / name, as_csv([("id", "first", "second"), *part], random.Random(5), "\n"))
    for split in ("300", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = sorted(tuple(r) for r in landing.read_upload(spark, str(tmp_path / "up.csv")).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "256m")
        assert got == [tuple(v or "" for v in row) for row in rows]


def test_a_task_holds_a_block_of_an_upload_at_a_time(spark, tmp_path):
    """What is sorted and counted together is no split: its windows run within blocks."""
    assert 2**records.BLOCK_BITS <= 4096  # rows that a window keeps without spilling
    path = str(write(tmp_path / "u.csv", 'a,b\n1,"2\n"\n'))
    plan = landing.read_upload(spark, path)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line and "sum(odd#" in line]
    assert windows and all("[block#" in line for line in windows)


def test_the_header_is_found_behind_blank_splits(spark, tmp_path):
    path = write(tmp_path / "blank.csv", "\n" * 500 + "a,b\n1,2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert [tuple(r) for r in landing.read_upload(spark, str(path)).collect()] == [("1", "2")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256m")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_rows_are_counted(spark, tmp_path):
    path = write(tmp_path / "long.csv", 'a,b\n1,2\n1,2,3\n"x,\ny",2,\n1\n\n"a ""q"", b","c,d"\n,,,,\n')
    landed = landing.land_csv(spark, str(path), datetime(2024, 1, 1))
    assert (landed.rows_loaded, landed.long_rows) == (6, 3)
    flat = write(tmp_path / "flat.csv", "a,b\n1,2\n1,2,3\n1\n")
    assert landing.land_csv(spark, str(flat), datetime(2024, 1, 1), False).long_rows == 1


def test_an_upload_of_one_file_has_many_tasks(spark, tmp_path):
    plan = landing.read_upload(spark, str(write(tmp_path / "x.csv", 'a,b\n1,"2\n"\n')))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "FileScan csv" not in plan and "SinglePartition" not in plan


def test_curated_queries_read_curated_layers_alone(spark, tmp_path):
    tables.ensure_namespaces(spark)
    spark.range(5).write.mode("overwrite").saveAsTable("raw.secret_rows")
    tables.materialize(spark.range(7).withColumnRenamed("id", "n"), "marts.open_rows")
    spark.sql("CREATE OR REPLACE VIEW serving.open_view AS SELECT * FROM marts.open_rows")
    spark.sql("CREATE OR REPLACE VIEW marts.leaky AS SELECT * FROM raw.secret_rows")
    path = str(tmp_path / "files")
    spark.range(3).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("session_rows")

    fine = [
        ("SELECT * FROM marts.open_rows", 7),
        ("WITH x AS (SELECT n FROM serving.open_view WHERE n > :low) SELECT a.n FROM x a JOIN x b ON a.n = b.n", 4),
        ("SELECT n, 'Relation of raw.secret_rows' AS t FROM marts.open_rows -- note", 7),
        ("SELECT 1 AS one", 1),
        ("SELECT n FROM marts.open_rows WHERE n < (SELECT max(n) FROM serving.open_view)", 6),
    ]
    for text, rows in fine:
        assert tables.query_curated(spark, text, low=2).count() == rows
    for text in (
        "SELECT * FROM raw.secret_rows",
        "WITH x AS (SELECT * FROM raw.secret_rows) SELECT count(*) FROM x",
        "SELECT * FROM marts.leaky",
        "SELECT n FROM marts.open_rows WHERE n IN (SELECT id FROM raw.secret_rows)",
        "SELECT n, (SELECT max(id) FROM raw.secret_rows) AS m FROM marts.open_rows",
        "SELECT * FROM marts.open_rows) UNION ALL (SELECT id FROM raw.secret_rows",
        f"SELECT * FROM parquet.`{path}`",
        "SELECT * FROM session_rows",
    ):
        with pytest.raises(PermissionError, match="readable"):
            tables.query_curated(spark, text)
    for text in (
        "DROP TABLE raw.secret_rows",
        "SELECT 1; DROP TABLE raw.secret_rows",
        "WITH x AS (SELECT 1 AS id) INSERT INTO raw.secret_rows SELECT * FROM x",
        "CREATE TABLE marts.made AS SELECT 1 AS one",
        "SELECT * FROM marts.nothing_there",
    ):
        with pytest.raises(Exception):
            tables.query_curated(spark, text)
    assert spark.table("raw.secret_rows").count() == 5 and not spark.catalog.tableExists("marts.made")
