"""A query per operator, and SQL for DuckDB that gives the same rows.

Outputs are integers, strings and exact sums, so that both engines agree to the last digit; what is irrational
comes as scaled integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import functions as A
from rowloom import operators as O
from rowloom import sources as S
from rowloom import streaming as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SEED = 42


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str, name: str, key: str | list[str], seed: int | None = None) -> DataFrame:
    return O.with_obs(read(spark, sf_dir, name), key, seed)


def exact(column: str | Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(18,2)")).cast("double")


def scaled(column: str | Column, by: int = 10_000) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * by + 0.5).cast("long")


EVENTS = "with o as (select *, row_number() over (order by event_id) as obs from events)"
ORDERS = "with o as (select *, row_number() over (order by o_orderkey) as obs from orders)"
PARTS = "with o as (select *, row_number() over (order by p_partkey) as obs from part)"
LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
VECTORS = "with o as (select vec_id, label, unnest(embedding) as v, unnest(range(1, len(embedding) + 1)) as pos from embeddings)"


# -- core ----------------------------------------------------------------------------------------


@query(
    """with f as (select event_id, event_type, value, ntile(5) over (partition by event_type order by event_id) as fold from events),
    tr as (select *, row_number() over (partition by event_type order by event_id) as r, count(*) over (partition by event_type) as c from f where fold <> 1),
    bal as (select event_id, event_type, value from (select *, min(c) over () as m from tr) x where r <= m),
    o as (select *, row_number() over (order by event_id) as obs from bal)
    select cast((obs-1)//32 + 1 as bigint) as batch_id, count(*) as n_obs, count(distinct event_type) as n_classes,
    cast(sum(cast(value as decimal(18,2))) as double) as sum_value from o group by 1"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified folds, one left out, classes balanced, in batches of 32."""
    folded = O.kfolds(numbered(spark, sf_dir, "events", "event_id"), 5, stratified="event_type")
    balanced = O.undersample(folded.where("_fold <> 1"), "event_type", seed=None).drop("_obs")
    batches = O.batched(O.with_obs(balanced, "event_id"), 32)
    return O.collate_with(batches, n_obs=F.count("*"), n_classes=F.countDistinct("event_type"), sum_value=exact("value")).withColumnRenamed("_batch", "batch_id")


@query("select count(*) as n from orders")
def numobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(O.numobs(read(spark, sf_dir, "orders")),)], "n long")


@query(f"{EVENTS} select obs, event_id from o")
def getobs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.getobs(numbered(spark, sf_dir, "events", "event_id")).select(F.col("_obs").alias("obs"), "event_id")


@query("select row_number() over (order by n_name desc) as obs, n_name from nation")
def container_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names met in a loop over a container, from its end."""
    met = [r.n_name for r in O.Obs(read(spark, sf_dir, "nation"), "n_name")]
    return spark.createDataFrame(list(enumerate(reversed(met), 1)), "obs long, n_name string")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate) as obs from lineitem")
def with_obs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.with_obs(read(spark, sf_dir, "lineitem").select(*LINES), LINES, one_task=0)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("_obs").alias("obs"))


@query(f"{ORDERS} select cast(p as bigint) as pos, o_orderkey from (values (1,5),(2,3),(3,5)) i(p, x) join o on o.obs = i.x")
def getobs_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.getobs(numbered(spark, sf_dir, "orders", "o_orderkey"), [5, 3, 5]).select(F.col("_pos").alias("pos"), "o_orderkey")


@query(f"{ORDERS} select o_orderkey, o_totalprice from o where obs = 7")
def getobs_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.getobs(numbered(spark, sf_dir, "orders", "o_orderkey"), 7).select("o_orderkey", "o_totalprice")


@query(f"{EVENTS} select obs - 20 as obs, event_id from o where obs between 21 and 100")
def obsview_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.obsview(numbered(spark, sf_dir, "events", "event_id"), range(21, 101)).select(F.col("_obs").alias("obs"), "event_id")


@query(f"{EVENTS} select obs - 20 as obs, event_id from o where obs between 21 and 30")
def obsview_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = O.obsview(numbered(spark, sf_dir, "events", "event_id"), range(21, 101))
    return O.obsview(view, range(1, 11)).select(F.col("_obs").alias("obs"), "event_id")


@query(f"{VECTORS} select cast(pos as bigint) as obs, count(*) as n, cast(sum(cast(floor(v * 1024) as bigint)) as bigint) as total from o group by pos")
def obsdim_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations along the vectors' components."""
    turned = O.obsdim(read(spark, sf_dir, "embeddings"), "embedding", key="vec_id", rows=True)
    return turned.groupBy(F.col("_dim").alias("obs")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("embedding").cast("double") * 1024)).alias("total"))


_DRAW = f"('0x' || substr(md5('{SEED}:' || i), 1, 13))::bigint"


@query(f"{ORDERS} select cast(i as bigint) as pos, o_orderkey from range(1, 1001) r(i) join o on o.obs = {_DRAW} % (select count(*) from orders) + 1")
def randobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.randobs(numbered(spark, sf_dir, "orders", "o_orderkey"), 1000, SEED).select(F.col("_pos").alias("pos"), "o_orderkey")


# -- maps, filters, groups -----------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice * (1 - l_discount) * 10 + 0.5) as bigint) as net10, l_quantity > 25 as large from lineitem")
def mapobs_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mapobs(
        {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "net10": lambda d: scaled(d.l_extendedprice * (1 - d.l_discount), 10), "large": lambda d: d.l_quantity > 25},
        read(spark, sf_dir, "lineitem"),
    )


@query("select event_id, value * 2 + 1 as y from events")
def mapobs_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mapobs(lambda d: [d.event_id, (d.value * 2 + 1).alias("y")], read(spark, sf_dir, "events"))


def _double(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"event_id": frame.event_id, "y": frame.value * 2 + 1})


@query("select event_id, value * 2 + 1 as y from events")
def mapobs_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mapobs(_double, read(spark, sf_dir, "events").select("event_id", "value"), "always", "event_id long, y double")


@query("select event_id, upper(event_type) as kind from events")
def mapobs_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mapobs(lambda r: (r.event_id, r.event_type.upper()), read(spark, sf_dir, "events").select("event_id", "event_type"), "never", "event_id long, kind string")


@query("select event_id, value + 1 as a, null as b from events union all select event_id, null, value - 1 from events")
def mapobs_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = O.mapobs((lambda d: [d.event_id, (d.value + 1).alias("a")], lambda d: [d.event_id, (d.value - 1).alias("b")]), read(spark, sf_dir, "events"))
    return first.unionByName(second, allowMissingColumns=True)


@query("select event_id, value from events where value > 100")
def filterobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.filterobs(lambda d: d.value > 100, read(spark, sf_dir, "events")).select("event_id", "value")


@query(f"{EVENTS} select event_type as grp, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total, min(obs) as first_obs, max(obs) as last_obs from o group by 1")
def groupobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = O.groupobs(lambda d: d.event_type, numbered(spark, sf_dir, "events", "event_id"), "grp")
    return grouped.groupBy("grp").agg(F.count("*").alias("n"), exact("value").alias("total"), F.min("_obs").alias("first_obs"), F.max("_obs").alias("last_obs"))


@query(f"{EVENTS} select obs, event_id from o where event_type = (select min(event_type) from events)")
def groupobs_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = numbered(spark, sf_dir, "events", "event_id")
    least = events.agg(F.min("event_type")).first()[0]
    return O.in_group(O.groupobs("event_type", events), least).select(F.col("_obs").alias("obs"), "event_id")


@query(
    """select cast(1 as integer) as src, row_number() over (order by c_custkey) as obs, c_name as name from customer
    union all select 2, row_number() over (order by s_suppkey) + (select count(*) from customer), s_name from supplier"""
)
def joinobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = numbered(spark, sf_dir, "customer", "c_custkey").select("_obs", F.col("c_name").alias("name"))
    suppliers = numbered(spark, sf_dir, "supplier", "s_suppkey").select("_obs", F.col("s_name").alias("name"))
    return O.joinobs(customers, suppliers).select(F.col("_src").alias("src"), F.col("_obs").alias("obs"), "name")


@query(f"select row_number() over (order by md5('{SEED}:0:' || o_orderkey), o_orderkey) as obs, o_orderkey from orders")
def shuffleobs_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.shuffleobs(read(spark, sf_dir, "orders"), "o_orderkey", SEED).select(F.col("_obs").alias("obs"), "o_orderkey")


@query(f"select row_number() over (order by md5('{SEED}:1:' || o_orderkey), o_orderkey) as obs, o_orderkey from orders")
def shuffleobs_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another epoch, numbered by ranges as a large table is."""
    return O.with_obs(read(spark, sf_dir, "orders"), "o_orderkey", SEED, epoch=1, one_task=0).select(F.col("_obs").alias("obs"), "o_orderkey")


# -- splits and folds ----------------------------------------------------------------------------


def _split_counts(data: DataFrame) -> DataFrame:
    return data.groupBy("_split").agg(F.count("*").alias("n"), F.min("_obs").alias("first_obs"), F.max("_obs").alias("last_obs")).withColumnRenamed("_split", "split")


_N = "(select count(*) from orders)"
_CUT1 = f"cast(round_even(cast({_N} as double) * 0.7, 0) as bigint)"


@query(f"{ORDERS} select cast(case when obs <= {_CUT1} then 1 else 2 end as integer) as split, count(*) as n, min(obs) as first_obs, max(obs) as last_obs from o group by 1")
def splitobs_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_counts(O.splitobs(numbered(spark, sf_dir, "orders", "o_orderkey"), 0.7))


@query(f"{ORDERS} select cast(case when obs <= 1000 then 1 else 2 end as integer) as split, count(*) as n, min(obs) as first_obs, max(obs) as last_obs from o group by 1")
def splitobs_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_counts(O.splitobs(numbered(spark, sf_dir, "orders", "o_orderkey"), 1000))


@query(
    f"""{ORDERS}, c as (select count(*) as n from orders), a as (select n, cast(round_even(n * 0.5, 0) as bigint) as n1 from c),
    b as (select n1, n1 + cast(round_even((n - n1) * ((0.3 * n) / (n - n1)), 0) as bigint) as n2 from a)
    select cast(case when obs <= n1 then 1 when obs <= n2 then 2 else 3 end as integer) as split, count(*) as n, min(obs) as first_obs, max(obs) as last_obs from o, b group by 1"""
)
def splitobs_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_counts(O.splitobs(numbered(spark, sf_dir, "orders", "o_orderkey"), (0.5, 0.3)))


@query(
    f"""with o as (select o_orderkey, row_number() over (order by md5('{SEED}:0:' || o_orderkey), o_orderkey) as obs from orders)
    select o_orderkey, cast(case when obs <= {_CUT1} then 1 else 2 end as integer) as split from o"""
)
def splitobs_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.splitobs(numbered(spark, sf_dir, "orders", "o_orderkey", SEED), 0.7).select("o_orderkey", F.col("_split").alias("split"))


@query(
    """with r as (select event_id, row_number() over (partition by event_type order by event_id) as k, count(*) over (partition by event_type) as c from events)
    select event_id, cast(case when k <= cast(round_even(c * 0.8, 0) as bigint) then 1 else 2 end as integer) as split from r"""
)
def splitobs_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.splitobs(numbered(spark, sf_dir, "events", "event_id"), 0.8, stratified="event_type").select("event_id", F.col("_split").alias("split"))


@query("select o_orderkey, cast(ntile(7) over (order by o_orderkey) as integer) as fold from orders")
def kfolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.kfolds(numbered(spark, sf_dir, "orders", "o_orderkey"), 7).select("o_orderkey", F.col("_fold").alias("fold"))


@query(
    """with f as (select c_custkey, ntile(5) over (order by c_custkey) as fold from customer)
    select c_custkey, cast(r as integer) as round, case when fold = r then 'val' else 'train' end as role from f, range(1, 6) t(r)"""
)
def kfolds_train_val_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = O.kfolds(numbered(spark, sf_dir, "customer", "c_custkey"), 5)
    return O.kfolds_long(folded, 5).select("c_custkey", F.col("_round").alias("round"), F.col("_role").alias("role"))


@query("select event_id, cast(ntile(5) over (partition by event_type order by event_id) as integer) as fold from events")
def kfolds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.kfolds(numbered(spark, sf_dir, "events", "event_id"), 5, stratified="event_type").select("event_id", F.col("_fold").alias("fold"))


@query(
    f"""with o as (select c_custkey, row_number() over (order by md5('{SEED}:0:' || c_custkey), c_custkey) as obs from customer)
    select c_custkey, cast(ntile(5) over (order by obs) as integer) as fold from o"""
)
def kfolds_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.kfolds(numbered(spark, sf_dir, "customer", "c_custkey", SEED), 5).select("c_custkey", F.col("_fold").alias("fold"))


@query(
    """with n as (select count(*) // (count(*) // 7) as p, count(*) // 7 as k, count(*) as n from customer), o as (select c_custkey, row_number() over (order by c_custkey) as obs from customer)
    select fold, count(*) as size, min(c_custkey) as first_key from (select c_custkey, case when obs <= (n % k) * (p + 1) then (obs - 1) // (p + 1) + 1 else (n % k) + (obs - 1 - (n % k) * (p + 1)) // p + 1 end as fold from o, n) x group by fold"""
)
def leavepout(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = O.leavepout(numbered(spark, sf_dir, "customer", "c_custkey"), 7)
    return folded.groupBy(F.col("_fold").alias("fold")).agg(F.count("*").alias("size"), F.min("c_custkey").alias("first_key"))


def _timeseries_sql(gap: int, most: int | None) -> str:
    start = "1" if most is None else f"greatest(1, n - (6 - i) * s - {gap} - {most} + 1)"
    return f"""with o as (select event_id, row_number() over (order by ts, event_id) as obs from events), n as (select count(*) as n, count(*) // 6 as s from events),
    b as (select i, {start} as a, n - (6 - i) * s - {gap} as b, n - (6 - i) * s + 1 as c, n - (5 - i) * s as d from n, range(1, 6) t(i))
    select cast(i as integer) as round, role, count(*) as n, min(obs) as first_obs, max(obs) as last_obs from
    (select i, obs, case when obs between a and b then 'train' when obs between c and d then 'val' end as role from o, b) x where role is not null group by i, role"""


def _rounds(data: DataFrame) -> DataFrame:
    return data.groupBy(F.col("_round").alias("round"), F.col("_role").alias("role")).agg(F.count("*").alias("n"), F.min("_obs").alias("first_obs"), F.max("_obs").alias("last_obs"))


@query(_timeseries_sql(0, None))
def timeseries_kfolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounds(O.timeseries_kfolds(numbered(spark, sf_dir, "events", ["ts", "event_id"]), 5))


@query(_timeseries_sql(10, 2000))
def timeseries_kfolds_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounds(O.timeseries_kfolds(numbered(spark, sf_dir, "events", ["ts", "event_id"]), 5, gap=10, max_train_size=2000))


# -- resampling ----------------------------------------------------------------------------------


def _oversample_sql(fraction: float, order: str) -> str:
    return f"""with c as (select toxic, count(*) as c from labels group by toxic), f as (select cast(round_even({fraction} * max(c), 0) as bigint) as f from c),
    r as (select l.doc_id, l.toxic, c.c, row_number() over (partition by l.toxic order by {order}) as r from labels l join c on l.toxic is not distinct from c.toxic),
    k as (select doc_id, toxic, case when f > c then f // c + case when r <= f % c then 1 else 0 end else 1 end as copies from r, f)
    select doc_id, toxic, cast(unnest(range(1, copies + 1)) as integer) as copy from k"""


@query(_oversample_sql(1.0, "doc_id"))
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.oversample(read(spark, sf_dir, "labels"), "toxic", seed=None, order_by="doc_id").select("doc_id", "toxic", F.col("_copy").alias("copy"))


@query(_oversample_sql(0.5, f"md5('{SEED}:0:' || doc_id), doc_id"))
def oversample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.oversample(read(spark, sf_dir, "labels"), "toxic", 0.5, SEED, "doc_id").select("doc_id", "toxic", F.col("_copy").alias("copy"))


def _undersample_sql(order: str) -> str:
    return f"""with c as (select quality, count(*) as c from labels group by quality), r as (select doc_id, quality, row_number() over (partition by quality order by {order}) as r from labels)
    select doc_id, quality from r where r <= (select min(c) from c)"""


@query(_undersample_sql("doc_id"))
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.undersample(read(spark, sf_dir, "labels"), "quality", None, "doc_id").select("doc_id", "quality")


@query(_undersample_sql(f"md5('{SEED}:0:' || doc_id), doc_id"))
def undersample_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.undersample(read(spark, sf_dir, "labels"), "quality", SEED, "doc_id").select("doc_id", "quality")


# -- batches, sequences, windows -----------------------------------------------------------------

_BATCH_SUMS = "count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total"


def _batch_sums(data: DataFrame) -> DataFrame:
    return O.collate_with(data, n=F.count("*"), total=exact("value")).withColumnRenamed("_batch", "batch")


@query(f"{EVENTS} select (obs - 1) // 256 + 1 as batch, {_BATCH_SUMS} from o group by 1")
def batchview_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch_sums(O.BatchView(numbered(spark, sf_dir, "events", "event_id"), 256).df)


@query(f"{EVENTS} select (obs - 1) // 256 + 1 as batch, {_BATCH_SUMS} from o where (obs - 1) // 256 + 1 <= (select count(*) from events) // 256 group by 1")
def batchview_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch_sums(O.BatchView(numbered(spark, sf_dir, "events", "event_id"), 256, partial=False).df)


@query(f"{EVENTS} select obs, event_id from o where (obs - 1) // 32 + 1 in (1, 3)")
def batchview_merge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.BatchView(numbered(spark, sf_dir, "events", "event_id"), 32)[[3, 1, 3]].select(F.col("_obs").alias("obs"), "event_id")


@query("select conv_id, count(*) as turns, string_agg(role, ',' order by turn) as roles, cast(sum(length(text)) as bigint) as chars from conversations group by conv_id")
def collate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("_obs", F.col("turn"))
    made = O.collate(turns, ["role", "text"], by="conv_id")
    chars = F.aggregate("text", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    return made.select("conv_id", F.size("role").cast("long").alias("turns"), F.array_join("role", ",").alias("roles"), chars.alias("chars"))


@query(f"{EVENTS} select obs, event_id from o where (obs - 1) // 32 + 1 = 5")
def batchview_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.BatchView(numbered(spark, sf_dir, "events", "event_id"), 32)[5].select(F.col("_obs").alias("obs"), "event_id")


@query(f"{EVENTS} select obs, event_id, (select cast(count(*) // 48 as bigint) from events) as batches from o")
def batchview_getobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of a view whose last, smaller batch is left out."""
    view = O.BatchView(numbered(spark, sf_dir, "events", "event_id"), 48, partial=False)
    return view.getobs().select(F.col("_obs").alias("obs"), "event_id", F.lit(len(view)).cast("long").alias("batches"))


@query(
    """with o as (select *, row_number() over (order by n_nationkey) as obs from nation)
    select (obs - 1) // 10 + 1 as batch, string_agg(n_name, ',' order by obs) as names, cast(sum(n_regionkey) as bigint) as regions from o group by 1"""
)
def dataloader_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function mapped over a loader's collated batches."""
    loader = O.DataLoader(read(spark, sf_dir, "nation"), "n_nationkey", 10, collate=True)
    made = [(i, *pair) for i, pair in enumerate(loader.map(lambda b: (",".join(b["n_name"]), sum(b["n_regionkey"]))), 1)]
    return spark.createDataFrame(made, "batch long, names string, regions long")


@query("select row_number() over (order by s_suppkey) as obs, s_name from supplier")
def eachobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations one by one."""
    met = [(i, r.s_name) for i, r in enumerate(O.eachobs(read(spark, sf_dir, "supplier"), "s_suppkey"), 1)]
    return spark.createDataFrame(met, "obs long, s_name string")


@query(f"{EVENTS} select (obs - 1) // 64 + 1 as batch, max(value) as most, count(distinct user_id) as users from o group by 1")
def collate_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = O.batched(numbered(spark, sf_dir, "events", "event_id"), 64)
    return O.collate_with(batches, most=F.max("value"), users=F.countDistinct("user_id")).withColumnRenamed("_batch", "batch")


@query(f"{EVENTS} select (obs - 1) // 100 + 1 as batch, string_agg(event_id, ',' order by obs) as ids, max(value) - min(value) as spread from o group by 1")
def dataloader_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a loader maps over its batches, as a table."""
    rows = O.collate(O.DataLoader(read(spark, sf_dir, "events"), "event_id", 100).table(), ["event_id", "value"])
    return rows.select(F.col("_batch").alias("batch"), F.array_join("event_id", ",").alias("ids"), (F.array_max("value") - F.array_min("value")).alias("spread"))


@query(
    f"""with o as (select event_id, row_number() over (order by md5('{SEED}:3:' || event_id), event_id) as obs from events)
    select (obs - 1) // 128 + 1 as batch, count(*) as n, min(event_id) as least, cast(sum(event_id) as bigint) as total from o group by 1"""
)
def dataloader_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    loader = O.DataLoader(read(spark, sf_dir, "events"), "event_id", 128, shuffle=True, seed=SEED)
    return O.collate_with(loader.table(epoch=3), n=F.count("*"), least=F.min("event_id"), total=F.sum("event_id")).withColumnRenamed("_batch", "batch")


@query("select label, count(*) as n, string_agg(vec_id, ',' order by vec_id) as ids from embeddings group by label")
def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").withColumn("_obs", F.col("vec_id"))
    return O.batch(vectors, ["vec_id", "embedding"], "label").select("label", F.size("embedding").cast("long").alias("n"), F.array_join("vec_id", ",").alias("ids"))


@query(f"{VECTORS} select vec_id, cast(pos as bigint) as pos, cast(v as double) as v from o")
def unbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.unbatch(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", F.col("_pos").alias("pos"), F.col("embedding").cast("double").alias("v"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turn lengths as a sequence."""
    turns = read(spark, sf_dir, "conversations").withColumn("_obs", F.col("turn"))
    sequences = O.collate(turns.withColumn("n", F.length("text").cast("long")), ["n"], by="conv_id")
    return sequences.withColumn("_obs", F.col("conv_id"))


_PADDED = """with t as (select conv_id, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations), m as (select max(k) as m from t),
    g as (select c.conv_id, p.i as step from (select distinct conv_id from t) c, (select unnest(range(1, m + 1)) as i from m) p),
    x as (select g.conv_id, g.step, coalesce(t.n, 0) as n from g left join t on t.conv_id = g.conv_id and t.k = g.step)"""


@query(f"{_PADDED} select conv_id, string_agg(n, ',' order by step) as padded from x group by conv_id")
def batch_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.batch_sequence(_lengths(spark, sf_dir), "n").select("conv_id", F.array_join("n", ",").alias("padded"))


@query(f"{_PADDED} select cast(step as bigint) as step, count(*) as n, md5(string_agg(n, ',' order by conv_id)) as digest from x group by step")
def batchseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = O.batchseq(_lengths(spark, sf_dir), "n")
    return steps.select(F.col("_step").alias("step"), F.size("n").cast("long").alias("n"), F.md5(F.array_join("n", ",")).alias("digest"))


def _window_sql(size: int, stride: int) -> str:
    return f"""{EVENTS}, w as (select obs, cast(sum(cast(value as decimal(18,2))) over (order by obs rows between current row and {size - 1} following) as double) as total, count(*) over (order by obs rows between current row and {size - 1} following) as n from o)
    select (obs - 1) // {stride} + 1 as win, n, total from w where (obs - 1) % {stride} = 0 and n = {size}"""


def _window_sums(data: DataFrame) -> DataFrame:
    return data.groupBy(F.col("_win").alias("win")).agg(F.count("*").alias("n"), exact("value").alias("total"))


@query(_window_sql(5, 1))
def slidingwindow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_sums(O.slidingwindow(numbered(spark, sf_dir, "events", "event_id"), 5))


@query(_window_sql(16, 4))
def slidingwindow_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_sums(O.slidingwindow(numbered(spark, sf_dir, "events", "event_id"), 16, 4))


# -- counts --------------------------------------------------------------------------------------


@query("select event_type, count(*) as n from events group by event_type")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.group_counts(read(spark, sf_dir, "events"), "event_type").withColumnRenamed("count", "n")


@query(f"{EVENTS} select event_type, string_agg(obs, ',' order by obs) as indices from o group by event_type")
def group_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.group_indices(numbered(spark, sf_dir, "events", "event_id"), "event_type").select("event_type", F.array_join("indices", ",").alias("indices"))


@query("with c as (select event_type, count(*) as c from events group by 1) select max(c) as most, min(c) as least from c")
def class_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.group_counts(read(spark, sf_dir, "events"), "event_type").agg(F.max("count").alias("most"), F.min("count").alias("least"))


# -- arrays --------------------------------------------------------------------------------------


def _chunk_counts(data: DataFrame) -> DataFrame:
    return data.groupBy(F.col("_chunk").alias("chunk")).agg(F.count("*").alias("n"), F.min("_obs").alias("first_obs"))


@query(f"{PARTS}, s as (select (count(*) + 6) // 7 as s from part) select (obs - 1) // s + 1 as chunk, count(*) as n, min(obs) as first_obs from o, s group by 1")
def chunk_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_counts(A.chunk_rows(numbered(spark, sf_dir, "part", "p_partkey"), n=7))


@query(f"{PARTS} select (obs - 1) // 300 + 1 as chunk, count(*) as n, min(obs) as first_obs from o group by 1")
def chunk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_counts(A.chunk_rows(numbered(spark, sf_dir, "part", "p_partkey"), size=300))


@query("with o as (select n_nationkey, row_number() over (order by n_nationkey) as obs from nation) select cast(case when obs <= 3 then 1 when obs <= 13 then 2 else 3 end as bigint) as chunk, count(*) as n, min(obs) as first_obs from o group by 1")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_counts(A.chunk_rows(numbered(spark, sf_dir, "nation", "n_nationkey"), size=[3, 10, 12]))


@query("select cast(p as bigint) as chunk, coalesce(string_agg(n_name, ',' order by n_nationkey), '') as names from range(1, 8) r(p) left join nation on n_regionkey + 1 = p group by p")
def chunk_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = numbered(spark, sf_dir, "nation", ["n_regionkey", "n_nationkey"]).withColumn("part", F.col("n_regionkey") + 1)
    return A.chunk_by_partition(nations, "part", ["n_name"], 7).select(F.col("_chunk").alias("chunk"), F.array_join("n_name", ",").alias("names"))


@query(f"{VECTORS} select vec_id, (pos - 1) // 10 + 1 as part, count(*) as n, cast(sum(cast(floor(v * 1024) as bigint)) as bigint) as total from o group by 1, 2")
def chunk_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.chunk_array("embedding", size=10)).alias("p", "x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + F.floor(v.cast("double") * 1024))
    return parts.select("vec_id", (F.col("p") + 1).cast("long").alias("part"), F.size("x").cast("long").alias("n"), total.alias("total"))


def _elements(data: DataFrame, value: Column, key: str = "vec_id") -> DataFrame:
    return data.select(key, F.posexplode(value).alias("p", "v")).select(key, (F.col("p") + 1).cast("long").alias("pos"), "v")


@query(f"{VECTORS}, g as (select vec_id, unnest(range(1, 71)) as pos from embeddings) select g.vec_id, cast(g.pos as bigint) as pos, coalesce(cast(o.v as double), -1.0) as v from g left join o using (vec_id, pos)")
def rpad_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(read(spark, sf_dir, "embeddings"), A.rpad_constant(F.col("embedding").cast("array<double>"), 70, -1.0))


@query(f"{VECTORS} select vec_id, cast(case when pos <= 64 then pos end as bigint) as pos, cast(v as double) as v from o")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a vector, put together again."""
    return _elements(read(spark, sf_dir, "embeddings"), A.flatten(A.chunk_array(F.col("embedding").cast("array<double>"), size=8)))


@query(f"{VECTORS} select vec_id, cast(pos as bigint) as pos, cast(v as double) as v from o")
def flatten_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of chunks of a vector, put together again."""
    chunks = F.transform(A.chunk_array(F.col("embedding").cast("array<double>"), size=16), lambda x: A.chunk_array(x, size=4))
    return _elements(read(spark, sf_dir, "embeddings"), A.flatten(chunks, ndims=3))


@query(f"{VECTORS}, g as (select vec_id, unnest(range(1, 73)) as pos from embeddings) select g.vec_id, cast((g.pos - 1) // 12 + 1 as bigint) as part, cast((g.pos - 1) % 12 + 1 as bigint) as pos, coalesce(cast(o.v as double), -1.0) as v from g left join o on o.vec_id = g.vec_id and o.pos = ((g.pos - 1) // 12) * 10 + (g.pos - 1) % 12 + 1 and (g.pos - 1) % 12 < 10 and o.pos <= 50 and (g.pos - 1) // 12 < 5")
def rpad_constant_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts of ten components, filled up to six of twelve."""
    parts = A.chunk_array(F.slice(F.col("embedding").cast("array<double>"), 1, 50), size=10)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.rpad_constant2(parts, (12, 6), -1.0)).alias("p", "x"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("part"), F.posexplode("x").alias("q", "v")).select("vec_id", "part", (F.col("q") + 1).cast("long").alias("pos"), "v")


@query(f"{VECTORS} select vec_id, cast(pos as bigint) as last, cast(pos as bigint) as first, cast(v as double) as v from o")
def unsqueeze_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components through a new dimension after and one before them."""
    x = F.col("embedding").cast("array<double>")
    pairs = F.arrays_zip(A.unsqueeze(x, 2)[0].alias("a"), A.unsqueeze(x, 1).alias("b"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pairs).alias("p", "e")).where(F.col("e.a") == F.col("e.b")[0])
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("last"), (F.col("p") + 1).cast("long").alias("first"), F.col("e.a").alias("v"))


@query(f"{VECTORS} select vec_id, cast((pos - 1) // 8 + 1 as bigint) as pos, cast((pos - 1) % 8 + 1 as bigint) as pos2, cast(floor(v * 1024) as bigint) as a, cast(floor(v * 1024) as bigint) * 2 as b from o")
def stack_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of two dimensions stacked along a new innermost one, and taken apart along each."""
    x = A.chunk_array(F.transform("embedding", lambda v: F.floor(v.cast("double") * 1024).cast("long")), size=8)
    twice = F.transform(x, lambda r: F.transform(r, lambda v: v * 2))
    both = read(spark, sf_dir, "embeddings").select("vec_id", A.stack(x, twice, dims=1, ndims=2).alias("x"))
    rows = A.unstack(both, "x", dims=3, ndims=3).withColumnRenamed("_pos", "pos")
    return A.unstack(rows, "x", dims=2, ndims=2).select("vec_id", "pos", F.col("_pos").alias("pos2"), F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query(f"{VECTORS} select cast((pos - 1) % 8 + 1 as bigint) as obs, count(*) as n, cast(sum(cast(floor(v * 1024) as bigint)) as bigint) as total from o group by 1")
def obsdim_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations along the inner dimension of vectors in chunks of 8."""
    chunks = read(spark, sf_dir, "embeddings").select("vec_id", A.chunk_array("embedding", size=8).alias("x"))
    turned = O.obsdim(chunks, "x", level=2, key="vec_id", rows=True)
    return turned.groupBy(F.col("_dim").alias("obs")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("x").cast("double") * 1024)).alias("total"))


@query("select vec_id, cast(1 as bigint) as outer_last, cast(len(embedding) as bigint) as inner_last, cast(len(embedding) as bigint) as outer_first, cast(1 as bigint) as inner_first from embeddings")
def unsqueeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, first = A.unsqueeze("embedding", 2), A.unsqueeze("embedding", 1)
    size = lambda c: F.size(c).cast("long")
    return read(spark, sf_dir, "embeddings").select("vec_id", size(last).alias("outer_last"), size(last[0]).alias("inner_last"), size(first).alias("outer_first"), size(first[0]).alias("inner_first"))


@query("select o_orderkey, '[' || o_orderkey || ',' || o_custkey || ']' as pair from orders")
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = A.stack(F.array("o_orderkey"), F.array("o_custkey"), dims=1)[0]
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(both, ","), F.lit("]")).alias("pair"))


@query("select n_nationkey, cast(1 as bigint) as pos, n_nationkey as v from nation union all select n_nationkey, 2, n_regionkey from nation")
def unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "nation").select("n_nationkey", A.stack(F.array("n_nationkey"), F.array("n_regionkey")).alias("x"))
    return A.unstack(pairs, "x").select("n_nationkey", F.col("_pos").alias("pos"), F.col("x")[0].alias("v"))


@query("with s as (select avg(cast(value as decimal(18,2))) as a, stddev_pop(value) as d, avg(value) as m from events) select event_id, cast(floor((value - m) / (d + 1e-5) * 1000 + 0.5) as bigint) as z from events, s")
def normalise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.normalise_rows(read(spark, sf_dir, "events"), "value", "z").select("event_id", scaled("z", 1000).alias("z"))


@query(f"{VECTORS}, s as (select vec_id, avg(cast(v as double)) as m, stddev_pop(cast(v as double)) as d from o group by 1) select vec_id, cast(pos as bigint) as pos, cast(floor((v - m) / (d + 1e-5) * 1000 + 0.5) as bigint) as v from o join s using (vec_id)")
def normalise_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(read(spark, sf_dir, "embeddings"), A.normalise("embedding")).withColumn("v", scaled("v", 1000))


@query("with s as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select o_orderkey, cast(floor((o_totalprice - lo) / (hi - lo + 1e-5) * 10000 + 0.5) as bigint) as z from orders, s")
def rescale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rescale_rows(read(spark, sf_dir, "orders"), "o_totalprice", "z").select("o_orderkey", scaled("z").alias("z"))


@query(f"{VECTORS}, s as (select vec_id, min(cast(v as double)) as lo, max(cast(v as double)) as hi from o group by 1) select vec_id, cast(pos as bigint) as pos, cast(floor((v - lo) / (hi - lo + 1e-5) * 10000 + 0.5) as bigint) as v from o join s using (vec_id)")
def rescale_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(read(spark, sf_dir, "embeddings"), A.rescale("embedding")).withColumn("v", scaled("v"))


@query(f"{VECTORS} select vec_id, cast(pos as bigint) as pos, cast(0 as double) as zero, cast(1 as integer) as one, 2.5 as fill, true as yes, false as no from o".replace("2.5 as fill", "cast(2.5 as double) as fill"))
def constants_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "embedding"
    all_ = F.arrays_zip(A.zeros_like(x).alias("zero"), A.ones_like(x, "int").alias("one"), A.fill_like(x, 2.5).alias("fill"), A.trues_like(x).alias("yes"), A.falses_like(x).alias("no"))
    return _elements(read(spark, sf_dir, "embeddings"), all_).select("vec_id", "pos", *(F.col("v")[c].alias(c) for c in ("zero", "one", "fill", "yes", "no")))


def _uniform_sql(salt: int) -> str:
    return f"cast(('0x' || substr(md5('{SEED}:{salt}:' || vec_id || ':' || pos), 1, 13))::bigint as double) / 4503599627370496.0"


@query(f"{VECTORS} select vec_id, cast(pos as bigint) as pos, {_uniform_sql(0)} as v from o")
def rand_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(read(spark, sf_dir, "embeddings"), A.rand_like("embedding", "vec_id", SEED))


@query(f"{VECTORS} select vec_id, cast(pos as bigint) as pos, cast(floor(sqrt(-2 * ln(1 - {_uniform_sql(1)})) * cos(2 * pi() * {_uniform_sql(2)}) * 10000 + 0.5) as bigint) as v from o")
def randn_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(read(spark, sf_dir, "embeddings"), A.randn_like("embedding", "vec_id", SEED)).withColumn("v", scaled("v"))


_BINS = [float(b) for b in range(0, 500, 20)]
_BIN_SQL = "(select unnest(range(0, 500, 20)) as b)"


def _bins(rev: bool = False) -> Column:
    return F.array(*(F.lit(b) for b in (reversed(_BINS) if rev else _BINS)))


@query(f"select event_id, (select cast(count(*) + 1 as integer) from {_BIN_SQL} where b < value) as first, (select cast(count(*) as integer) from {_BIN_SQL} where b <= value) as last from events")
def searchsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", A.searchsortedfirst(_bins(), "value").alias("first"), A.searchsortedlast(_bins(), "value").alias("last"))


@query(f"select event_id, (select cast(count(*) + 1 as integer) from {_BIN_SQL} where b > value) as first, (select cast(count(*) as integer) from {_BIN_SQL} where b >= value) as last from events")
def searchsorted_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", A.searchsortedfirst(_bins(True), "value", True).alias("first"), A.searchsortedlast(_bins(True), "value", True).alias("last"))


@query(
    """with a as (select o_totalprice as x, 1 as b, null as k from orders union all select p_retailprice, 0, p_partkey from part)
    select k as p_partkey, cast(s + 1 as bigint) as first from (select k, b, coalesce(sum(b) over (order by x, b range between unbounded preceding and current row), 0) as s from a) t where b = 0"""
)
def searchsorted_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of prices among all orders' totals."""
    found = A.searchsorted_rows(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", read(spark, sf_dir, "orders"), "o_totalprice", "first")
    return found.select("p_partkey", "first")


@query(f"{ORDERS} select o_orderkey, o_totalprice from o order by o_totalprice desc, obs limit 100")
def topk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topk_rows(numbered(spark, sf_dir, "orders", "o_orderkey"), "o_totalprice", 100).select("o_orderkey", "o_totalprice")


def _topk_sql(order: str) -> str:
    return f"{VECTORS} select vec_id, cast(r as bigint) as rank, cast(v as double) as v, cast(pos as bigint) as pos from (select *, row_number() over (partition by vec_id order by v {order}, pos) as r from o) x where r <= 3"


def _top3(spark: SparkSession, sf_dir: str, rev: bool) -> DataFrame:
    top = A.topk(F.col("embedding").cast("array<double>"), 3, rev)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(top["values"].alias("v"), top["indices"].alias("pos"))).alias("p", "e")).select("vec_id", (F.col("p") + 1).cast("long").alias("rank"), "e.v", "e.pos")


@query(_topk_sql("desc"))
def topk_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top3(spark, sf_dir, True)


@query(_topk_sql("asc"))
def topk_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top3(spark, sf_dir, False)


@query(f"{EVENTS} select event_type, event_id, cast(r as integer) as rank from (select *, row_number() over (partition by event_type order by value desc, obs) as r from o) x where r <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topk_per_group(numbered(spark, sf_dir, "events", "event_id"), "value", 5, "event_type").select("event_type", "event_id", F.col("_rank").alias("rank"))


# -- generated data ------------------------------------------------------------------------------


@query(f"select i + 1 as obs, cast(floor(i * {2 * math.pi / 49!r} * 10000 + 0.5) as bigint) as x, cast(floor(sin(i * {2 * math.pi / 49!r}) * 10000 + 0.5) as bigint) as y from range(50) t(i)")
def make_sin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.make_sin(spark, noise=0.0).select(F.col("_obs").alias("obs"), scaled("x").alias("x"), scaled("y").alias("y"))


@query("select i + 1 as obs, cast(floor(((0.8 * ((i - 100) / 10.0) + 0.5) * ((i - 100) / 10.0) + 2.0) * 1000 + 0.5) as bigint) as y from range(201) t(i)")
def make_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = spark.range(201).select((F.col("id") + 1).alias("_obs"), ((F.col("id") - 100) / 10.0).alias("x"))
    return S.make_poly(xs, [0.8, 0.5, 2.0], noise=0.0).select(F.col("_obs").alias("obs"), scaled("y", 1000).alias("y"))


@query(
    f"""with p as (select i, i * {math.pi / 16!r} as a, 6.5 * (104 - i) / 104.0 as r from range(97) t(i))
    select i + 1 as obs, cast(floor(r * sin(a) * 10000 + 0.5) as bigint) as x1, cast(floor(r * cos(a) * 10000 + 0.5) as bigint) as x2, cast(1 as integer) as y from p
    union all select i + 98, cast(floor(-r * sin(a) * 10000 + 0.5) as bigint), cast(floor(-r * cos(a) * 10000 + 0.5) as bigint), 0 from p"""
)
def make_spiral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.make_spiral(spark, noise=0.0).select(F.col("_obs").alias("obs"), scaled("x1").alias("x1"), scaled("x2").alias("x2"), "y")


def _noise_sql(salt: int) -> str:
    u = lambda k: f"(cast(('0x' || substr(md5('{SEED}:{k}:' || i), 1, 13))::bigint as double) / 4503599627370496.0)"
    return f"sqrt(-2 * ln(1 - {u(2 * salt)})) * cos(2 * pi() * {u(2 * salt + 1)})"


@query(f"select i + 1 as obs, cast(floor((sin(i * {2 * math.pi / 99!r}) + 0.3 * {_noise_sql(0)}) * 10000 + 0.5) as bigint) as y from range(100) t(i)")
def make_sin_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.make_sin(spark, 100, seed=SEED).select(F.col("_obs").alias("obs"), scaled("y").alias("y"))


@query(f"select i as obs, cast(floor((2.0 * (i / 10.0) - 1.0 + 0.1 * {_noise_sql(0)}) * 10000 + 0.5) as bigint) as y from range(1, 101) t(i)")
def make_poly_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = spark.range(1, 101).select(F.col("id").alias("_obs"), (F.col("id") / 10.0).alias("x"))
    return S.make_poly(xs, [2.0, -1.0], seed=SEED).select(F.col("_obs").alias("obs"), scaled("y").alias("y"))


@query(
    f"""with p as (select i, case when i < 97 then i else i - 97 end as k, case when i < 97 then 1.0 else -1.0 end as s from range(194) t(i)),
    q as (select i, s, k * {math.pi / 16!r} as a, 6.5 * (104 - k) / 104.0 as r from p)
    select i + 1 as obs, cast(floor((s * r * sin(a) + 0.1 * {_noise_sql(0)}) * 10000 + 0.5) as bigint) as x1, cast(floor((s * r * cos(a) + 0.1 * {_noise_sql(1)}) * 10000 + 0.5) as bigint) as x2 from q"""
)
def make_spiral_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.make_spiral(spark, seed=SEED).select(F.col("_obs").alias("obs"), scaled("x1").alias("x1"), scaled("x2").alias("x2"))


_MOON = f"pi() * (cast(('0x' || substr(md5('{SEED}:100:' || i), 1, 13))::bigint as double) / 4503599627370496.0)"


@query(
    f"""with p as (select i, {_MOON} as t from range(200) r(i)),
    q as (select i, case when i < 100 then cos(t) else 1 - cos(t) end + 0.1 * {_noise_sql(0)} as x1, case when i < 100 then sin(t) else 0.5 - sin(t) end + 0.1 * {_noise_sql(1)} as x2, cast(case when i < 100 then 1 else 2 end as integer) as y from p)
    select row_number() over (order by md5('{SEED}:0:' || i), i) as obs, cast(floor(x1 * 10000 + 0.5) as bigint) as x1, cast(floor(x2 * 10000 + 0.5) as bigint) as x2, y from q"""
)
def make_moons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.make_moons(spark, 200, noise=0.1, seed=SEED).select(F.col("_obs").alias("obs"), scaled("x1").alias("x1"), scaled("x2").alias("x2"), "y")


# -- containers, files, sinks, streams -----------------------------------------------------------


@query("select cast(i as bigint) as obs, cast(i * i as bigint) as square, 'n' || i as name from range(1, 101) t(i)")
def from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.from_arrays(spark, {"square": [i * i for i in range(1, 101)], "name": [f"n{i}" for i in range(1, 101)]}, "square long, name string")
    return made.withColumnRenamed("_obs", "obs")


@query("select row_number() over (order by r_regionkey) as obs, r_regionkey, r_name from region")
def from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [tuple(r) for r in read(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey", "r_name").collect()]
    return S.from_rows(spark, rows, "r_regionkey int, r_name string").withColumnRenamed("_obs", "obs")


@query("select cast(i as bigint) as obs, cast(i * i as bigint) as square from range(1, 1001) t(i)")
def custom_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container given by its size and a function of the index."""
    S.register_container(spark, "squares", lambda: 1000, lambda i: (i * i,), "square long")
    return spark.read.format("squares").load().withColumnRenamed("_obs", "obs")


@query("select species, count(*) as n, cast(sum(cast(sepal_length as decimal(18,2))) as double) as total from (select event_type as species, (event_id % 50) / 10.0 as sepal_length from events) x group by 1")
def load_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the iris layout, here made of events."""
    path = S.working_folder(spark, "iris")
    lengths = [((F.col("event_id") % 50) / 10.0).alias(c) for c in "abcd"]
    S.write_table(read(spark, sf_dir, "events").select(*lengths, "event_type"), path, "csv")
    return S.load_iris(spark, path).groupBy("species").agg(F.count("*").alias("n"), exact("sepal_length").alias("total"))


@query("select n_regionkey, n_nationkey, n_name from nation")
def sink_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in folders by a column, and read again."""
    path = S.working_folder(spark, "nations")
    S.write_table(read(spark, sf_dir, "nation"), path, by=["n_regionkey"])
    return spark.read.parquet(path).select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "n_nationkey", "n_name")


@query("select event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from events where value > 50 group by event_type")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator on each micro-batch of a stream of files."""
    source = read(spark, sf_dir, "events")
    files, out = S.working_folder(spark, "files"), S.working_folder(spark, "stream")
    S.write_table(source, files)
    stream = spark.readStream.schema(source.schema).parquet(files)
    R.each_batch(stream, lambda b: O.filterobs("value > 50", b).select("event_type", "value"), out, S.working_folder(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), exact("value").alias("total"))
