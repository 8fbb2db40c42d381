"""Every registered query against its SQL."""

import json
from collections import defaultdict
from pathlib import Path
from urllib.parse import unquote, urlparse

import duckdb
import pytest

import __spark_entry__ as registered
from tests.conftest import SF_DIR
from tests.oracle import differences
from tillstream.operators import flatten_line_items, loyalty_points, notification_messages, parse_invoices
from tillstream.plans.catalog import QUERIES
from tillstream.plans.oracles import ORACLES
from tillstream.schemas import FLAT_SCHEMA, TOPIC_SCHEMA
from tillstream.sources import order_topic
from tillstream.storage import remove_run_folders, run_folder

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents")
LONG_ORDER = 4


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    """Tables in which one order has many line items, many have no order, one part is in many, and lookups are missing."""
    folder = tmp_path_factory.mktemp("skewed")
    changed = {
        "lineitem": f"""select * replace (
                case when l_suppkey % 3 > 0 then {LONG_ORDER} else l_orderkey end as l_orderkey,
                case when l_suppkey % 3 = 1 then 17 else l_partkey end as l_partkey)
            from (select * from lineitem union all select * from lineitem)
            union all select * replace (null as l_orderkey) from lineitem""",
        "part": "select * from part where p_partkey <> 18",
        "customer": "select * from customer where c_custkey % 10 > 0",
        "nation": "select * from nation where n_nationkey <> 3",
    }
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
        for name in TABLES:
            query = changed.get(name, f"select * from {name}")
            connection.execute(f"copy ({query}) to '{folder}/{name}.parquet' (format parquet)")
    return str(folder)


def test_every_query_has_its_sql():
    assert ORACLES.keys() == QUERIES.keys()
    assert QUERIES.items() <= registered.queries().items()
    assert ORACLES.items() <= registered.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    result = QUERIES[name](spark, SF_DIR)
    assert not result.isEmpty()
    assert differences(result, ORACLES[name], SF_DIR) == ({}, {})


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_skewed_tables(spark, skewed_dir, name):
    result = QUERIES[name](spark, skewed_dir)
    assert differences(result, ORACLES[name], skewed_dir) == ({}, {})


@pytest.fixture(scope="module")
def folder_dir(spark, tmp_path_factory):
    """Each table as a folder of several files."""
    folder = tmp_path_factory.mktemp("folders")
    for name in TABLES:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["parse_invoices", "flatten_line_items", "invoice_job_messages", "event_props"])
def test_query_on_tables_of_many_files(spark, folder_dir, name):
    result = QUERIES[name](spark, folder_dir)
    assert differences(result, ORACLES[name], folder_dir) == ({}, {})
    assert differences(result, ORACLES[name], SF_DIR) == ({}, {})


def test_entry(spark):
    assert registered.entry(spark).count() == 6000


def test_orders_without_items(spark):
    """They are invoices, with a notification, but have no flat row."""
    invoices = parse_invoices(order_topic(spark, SF_DIR)).cache()
    without = invoices.filter("value.InvoiceLineItems is null")
    assert without.count() == without.filter("value.NumberOfItems = 0").count() > 0
    assert notification_messages(loyalty_points(without)).count() == without.count()
    assert flatten_line_items(without).count() == 0
    assert invoices.count() == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    invoices.unpersist()


def test_topic_schema(spark):
    fields = [f"{field.name} {field.dataType.simpleString()}" for field in order_topic(spark, SF_DIR).schema]
    assert fields == [" ".join(field.split()) for field in TOPIC_SCHEMA.split(",")]


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """One order has 6,000 lines; some keys have more than six digits, and some orders have no key."""
    folder = tmp_path_factory.mktemp("long")
    changed = {
        "orders": """select * replace (case when o_orderkey % 3 = 0 then o_orderkey + 1234560 when o_orderkey % 7 = 1
                then null else o_orderkey end as o_orderkey) from orders""",
        "lineitem": f"""select * replace ({LONG_ORDER} as l_orderkey) from
            (select * from lineitem union all select * from lineitem) limit 6000""",
    }
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
            query = changed.get(name, f"select * from {name}")
            connection.execute(f"copy ({query}) to '{folder}/{name}.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["parse_invoices", "loyalty_points", "notification_messages", "flatten_line_items"])
def test_query_on_long_orders_and_keys(spark, long_dir, name):
    assert differences(QUERIES[name](spark, long_dir), ORACLES[name], long_dir) == ({}, {})


def test_an_order_is_one_record_at_any_size(spark, long_dir):
    invoices = parse_invoices(order_topic(spark, long_dir)).filter(f"value.InvoiceNumber = '{LONG_ORDER}'")
    (invoice,) = invoices.collect()
    assert invoice.value.NumberOfItems == len(invoice.value.InvoiceLineItems) == 6000
    (points,) = loyalty_points(invoices).collect()
    assert points.EarnedLoyaltyPoints == points.TotalAmount * 0.2
    assert notification_messages(loyalty_points(invoices)).count() == 1


def test_pin_codes_of_long_keys_differ(spark, long_dir):
    pins = parse_invoices(order_topic(spark, long_dir)).select("value.InvoiceNumber", "value.DeliveryAddress.PinCode")
    found = {row.InvoiceNumber: row.PinCode for row in pins.filter("length(InvoiceNumber) > 6").collect() if row.PinCode}
    assert len(found) > 10 and all(key == pin for key, pin in found.items())


def test_restarted_stream_takes_each_half_once(spark):
    remove_run_folders(spark)
    rows = QUERIES["restarted_stream"](spark, SF_DIR)
    folder = rows.inputFiles()[0].rsplit("/output/", 1)[0]
    topic = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/topic")
    assert topic.count() == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    assert rows.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    # Two starts, a batch of each, and each batch has the line items of the half that had arrived since.
    commits = spark.read.text(f"{folder}/checkpoints/flatten/commits").select("_metadata.file_name").distinct().collect()
    assert {row.file_name for row in commits} == {"0", "1"}
    for half in (0, 1):
        log = Path(unquote(urlparse(folder).path), "output", "_spark_metadata", str(half)).read_text().splitlines()
        files = [json.loads(line)["path"] for line in log[1:]]
        batch = spark.read.schema(FLAT_SCHEMA).json(files)
        arrived = flatten_line_items(parse_invoices(spark.read.parquet(f"{folder}/topic/{half}")))
        assert 0 < batch.count() < rows.count() and batch.exceptAll(arrived).isEmpty() and arrived.exceptAll(batch).isEmpty()
    assert remove_run_folders(spark) == 1 and remove_run_folders(spark) == 0


def test_run_folders_are_removed(spark, tmp_path):
    folder = run_folder(spark)
    spark.range(3).write.parquet(f"{folder}/table")
    assert spark.read.parquet(f"{folder}/table").count() == 3
    remove_run_folders(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/table")


def test_items_are_in_line_order(spark):
    lines = defaultdict(list)
    for row in spark.read.parquet(f"{SF_DIR}/lineitem.parquet").collect():
        lines[str(row.l_orderkey)].append((row.l_linenumber, str(row.l_partkey)))
    # Only orders whose line numbers differ have one right order.
    expected = {key: sorted(rows) for key, rows in lines.items() if len(dict(rows)) == len(rows)}
    invoices = parse_invoices(order_topic(spark, SF_DIR))
    records = invoices.select("value.InvoiceNumber", "value.InvoiceLineItems.ItemCode").collect()
    found = {key: codes for key, codes in records if key in expected}
    assert found == {key: [code for _, code in rows] for key, rows in expected.items()}
    assert any(len(codes) > 2 for codes in found.values())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_created_time_does_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        result = QUERIES["flatten_line_items"](spark, SF_DIR)
        assert differences(result, ORACLES["flatten_line_items"], SF_DIR) == ({}, {})
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
