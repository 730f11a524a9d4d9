"""Queries that read files: tables are written in a data set's own form first, then read by its adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time_us
from ..operators.shared import new_path
from ..sources import adapters, files, readers
from .queries import event_transfers, query
from .sql import EVENTS, with_

ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderpriority", F.col("o_totalprice").cast("double"))


def _put(df: DataFrame, path: str, **options: str | bool) -> None:
    df.write.options(**({"header": True} | options)).csv(path)


@query
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "files")
    _put(_orders(spark, sf_dir), path)
    return readers.read_csv(spark, path, schema=ORDERS)


@query
def csv_custom_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "files")
    text = F.concat(F.col("o_orderpriority"), F.lit(', "as is"'))
    _put(_orders(spark, sf_dir).withColumn("o_orderpriority", text), path, quote="'", quoteAll=True)
    return readers.read_csv(spark, path, schema=ORDERS, quote="'")


@query
def csv_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "files")
    _put(_orders(spark, sf_dir), path, header=False)
    names = {k: c for k, c in enumerate(("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"))}
    out = readers.read_csv(spark, path, header=False, rename=names)
    return out.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderpriority", F.col("o_totalprice").cast("double"))


@query
def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one to three fields; the first is kept, quotes and commas and all."""
    path = new_path(spark, "files")
    o = _orders(spark, sf_dir)
    first = F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit(", x"))
    o.select(F.concat(first, F.repeat(F.lit("\tmore"), F.col("o_orderkey").cast("int") % 3)).alias("value")).write.text(path)
    return readers.read_lines(spark, path)


@query
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "files") + "/t.parquet"
    _orders(spark, sf_dir).write.parquet(path)
    return readers.read_table(spark, path)


def _small(spark: SparkSession, root: str, *names: str) -> None:
    for n in names:
        spark.range(1).write.mode("overwrite").option("header", True).csv(f"{root}/{n}")


@query
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found for a name, for terms, and for a list of names, and what is refused."""
    root = new_path(spark, "files")
    _small(spark, root, "x/deep/a.csv", "y/the_log.csv", "b.csv")
    last = lambda f: f.rpartition("/")[2]
    rows = [("named", last(files.find_file(root, "b.csv"))), ("below", last(files.find_file(root, "a.csv"))), ("preferred", last(files.find_tabular(root, ("log",)))), ("first", last(files.find_tabular(root, ("none",))))]
    rows.append(("required", ",".join(map(last, files.require_files(root, ["a.csv", "b.csv"])))))
    for case, call in (("absent", lambda: files.find_file(root, "c.csv")), ("one absent", lambda: files.require_files(root, ["a.csv", "c.csv"]))):
        try:
            rows.append((case, call()))
        except FileNotFoundError as e:
            rows.append((case, type(e).__name__))
    return spark.createDataFrame(rows, "asked string, found string")


def _zip(spark: SparkSession, path: str, members: dict[str, str]) -> None:
    """A small archive, written through Hadoop's file system."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = jvm.java.util.zip.ZipOutputStream(at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at))
    for name, text in members.items():
        out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        data = bytearray(text.encode())
        out.write(data, 0, len(data))
        out.closeEntry()
    out.close()


@query
def zip_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as a file in an archive, unpacked and read; an archive that reaches outside gives nothing."""
    root = new_path(spark, "files")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").orderBy("r_regionkey").limit(1_000).collect()
    _zip(spark, f"{root}/r.zip", {"in/regions.csv": "r_regionkey,r_name\n" + "".join(f"{k},{n}\n" for k, n in regions)})
    _zip(spark, f"{root}/bad.zip", {"../outside.csv": "a\n"})
    (path,) = files.extract_zip(f"{root}/r.zip", f"{root}/out")
    try:
        files.extract_zip(f"{root}/bad.zip", f"{root}/out")
        refused = False
    except ValueError:
        refused = not files.exists(f"{root}/outside.csv")
    return readers.read_csv(spark, path, schema="r_regionkey long, r_name string").withColumn("refused", F.lit(refused))


@query
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which adapter a name leads to, whatever its case and separators; unknown names and variants where there are none."""
    rows = [(n, adapters.resolve_adapter(n).__name__) for n in ("ibm", "IBM_AML", "paysim", "BankSim", "SAML_D", "elliptic", "Elliptic++")]
    for n, call in (("no such set", lambda: adapters.resolve_adapter("no such set")), ("paysim, variant", lambda: adapters.load_dataset(spark, "paysim", sf_dir, variant="hi-small"))):
        try:
            call()
        except ValueError as e:
            rows.append((n, type(e).__name__))
    return spark.createDataFrame(rows, "name string, adapter string")


@query
def bank_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "files")
    t = event_transfers(spark, sf_dir)
    _put(t.select(F.date_format("timestamp", "yyyy/MM/dd HH:mm").alias("Timestamp"), F.col("source").alias("Account"), F.when(F.col("seq") % 11 != 0, F.concat(F.lit("T"), F.col("target"))).alias("Account.1"), F.col("amount").alias("Amount Received"), F.col("label").alias("Is Laundering")), f"{root}/HI-Small_Trans.csv")
    out = adapters.load_dataset(spark, "ibm", root).transactions()
    return out.select("source", "target", time_us(F.col("timestamp")).alias("t_us"), F.round(F.col("amount").cast("double"), 4).alias("amount"), F.col("label").cast("long"))


def _stepped(t: DataFrame, source: str, target: str, label: str, quote: str = "") -> DataFrame:
    name = lambda c, lead: F.concat(F.lit(quote + lead), F.col(c), F.lit(quote))
    return t.select((F.col("seq") % 700).alias("step"), name("source", "C").alias(source), name("target", "M").alias(target), "amount", F.col("label").alias(label))


@query
def mobile_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "files")
    _put(_stepped(event_transfers(spark, sf_dir), "nameOrig", "nameDest", "isFraud"), f"{root}/PS_log.csv")
    return _plain(adapters.load_dataset(spark, "paysim", root).transactions())


@query
def card_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "files")
    _put(_stepped(event_transfers(spark, sf_dir), "customer", "merchant", "fraud", "'"), f"{root}/bs140513_032310.csv")
    return _plain(adapters.load_dataset(spark, "banksim", root).transactions())


def _plain(out: DataFrame) -> DataFrame:
    return out.select("source", "target", time_us(F.col("timestamp")).alias("t_us"), F.round(F.col("amount").cast("double"), 4).alias("amount"), F.col("label").cast("long"))


@query
def monitoring_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "files")
    t = event_transfers(spark, sf_dir)
    _put(t.select(F.date_format("timestamp", "yyyy-MM-dd").alias("Date"), F.date_format("timestamp", "HH:mm:ss").alias("Time"), F.concat(F.lit("S"), F.col("source")).alias("Sender_account"), F.concat(F.lit("R"), F.col("target")).alias("Receiver_account"), F.col("amount").alias("Amount"), F.col("label").alias("Is_laundering")), f"{root}/SAML-D_transactions.csv")
    return _plain(adapters.load_dataset(spark, "saml-d", root).transactions())


def _ledger(spark: SparkSession, sf_dir: str, name: str, parts: tuple[str, str, str], header: bool) -> DataFrame:
    root = new_path(spark, "files")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    _put(o.select(F.col("o_orderkey").alias("txId"), (F.col("o_orderkey") % 49).alias("Time step"), F.col("o_totalprice").alias("f")), f"{root}/{parts[0]}", header=header)
    kind = F.when(F.col("o_orderkey") % 3 == 0, "1").when(F.col("o_orderkey") % 3 == 1, "2").otherwise("unknown")
    _put(o.where("o_orderkey % 4 != 0").select(F.col("o_orderkey").alias("txId"), kind.alias("class")), f"{root}/{parts[1]}")
    _put(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("txId1"), F.col("o_orderkey").alias("txId2")), f"{root}/{parts[2]}")
    g = adapters.load_dataset(spark, name, root).graph()
    nodes = g.nodes.select("transaction_id", time_us(F.col("timestamp")).alias("t_us"), F.col("label").cast("long"))
    return nodes.join(g.edges.select(F.col("source_transaction_id").alias("transaction_id"), "target_transaction_id", "edge_relation"), "transaction_id", "left")


@query
def ledger_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir, "elliptic", adapters.LabelledLedger.files, False)


@query
def ledger_plus_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir, "elliptic++", adapters.LabelledLedgerPlus.files, True)


_O = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, {0} AS o_orderpriority, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders"
_STEPPED = "SELECT 'C' || source AS source, 'M' || target AS target, seq % 700 * {0} AS t_us, round(amount, 4) AS amount, CAST(label AS BIGINT) AS label FROM ev"
_LEDGER = """
SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, o_orderkey % 49 * 86400000000 AS t_us, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 0 END::BIGINT AS label,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS target_transaction_id, CASE WHEN o_orderkey % 2 = 0 THEN 'precomputed' END AS edge_relation FROM orders"""

SQL = {
    "csv_scan": _O.format("o_orderpriority"),
    "csv_custom_quote": _O.format("o_orderpriority || ', \"as is\"'"),
    "csv_headerless": _O.format("o_orderpriority"),
    "parquet_scan": _O.format("o_orderpriority"),
    "ragged_lines": "SELECT '\"' || o_orderkey || ', x' AS pattern FROM orders",
    "file_lookup": "SELECT * FROM (VALUES ('named', 'b.csv'), ('below', 'a.csv'), ('preferred', 'the_log.csv'), ('first', 'b.csv'), ('required', 'a.csv,b.csv'), ('absent', 'FileNotFoundError'), ('one absent', 'FileNotFoundError')) t(asked, found)",
    "zip_extraction": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, true AS refused FROM region",
    "dataset_registry": "SELECT * FROM (VALUES ('ibm', 'BankTransfers'), ('IBM_AML', 'BankTransfers'), ('paysim', 'MobileMoney'), ('BankSim', 'CardPayments'), ('SAML_D', 'MonitoringAlerts'), ('elliptic', 'LabelledLedger'), ('Elliptic++', 'LabelledLedgerPlus'), ('no such set', 'ValueError'), ('paysim, variant', 'ValueError')) t(name, adapter)",
    "bank_transfers": with_(EVENTS) + "SELECT source, 'T' || target AS target, t_us - t_us % 60000000 AS t_us, round(amount, 4) AS amount, CAST(label AS BIGINT) AS label FROM ev WHERE seq % 11 <> 0",
    "mobile_money": with_(EVENTS) + _STEPPED.format("3600000000"),
    "card_payments": with_(EVENTS) + _STEPPED.format("86400000000"),
    "monitoring_alerts": with_(EVENTS) + "SELECT 'S' || source AS source, 'R' || target AS target, t_us - t_us % 1000000 AS t_us, round(amount, 4) AS amount, CAST(label AS BIGINT) AS label FROM ev",
    "ledger_graph": _LEDGER,
    "ledger_plus_graph": _LEDGER,
}
