"""The registered queries and their SQL, by inventory ID. Each reads whole tables; pairs, gaps and classes derive from them by rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsynth import detect, expr, features, gate, impute, metrics, privacy, report, sample, schema, synth
from tabsynth.cv import augmented_classification_cv, augmented_regression_cv, regression_cv, with_target
from tabsynth.io import read_table, write_datasets, write_report
from tabsynth.ordered import number_within
from tabsynth.pipeline import Config, run_pipeline
from tabsynth.rand import draw
from tabsynth.session import shared_dir

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


PAIR = {
    "qty": "case when l_orderkey % 7 = 0 then null else l_quantity end", "price": "l_extendedprice * case when l_orderkey % 2 = 1 then 1.05 else 1 end",
    "disc": "l_discount + 0.0", "flag": "case when l_orderkey % 11 = 0 then null else l_returnflag end", "cost": "case when l_orderkey % 13 = 0 then null else l_quantity * 1000 + l_extendedprice * 0.5 end",
}
PAIR_META = {"qty": "numerical", "price": "numerical", "disc": "numerical", "flag": "categorical", "cost": "numerical"}
PAIR_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in PAIR.items()) + ", case when l_orderkey % 2 = 0 then 'real' else 'synth' end as side from lineitem"
NUMBERS = ["qty", "price", "disc", "cost"]


def pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").selectExpr(*[f"cast({e} as {'string' if c == 'flag' else 'double'}) as {c}" for c, e in PAIR.items()], "l_orderkey % 2 = 0 as r")
    return rows.where("r").drop("r"), rows.where("not r").drop("r")


CUSTOMER = {"k": "c_custkey", "bal": "case when c_custkey % 11 = 0 then null else c_acctbal end", "seg": "case when c_custkey % 13 = 0 then null else c_mktsegment end", "nat": "cast(c_nationkey as double)", "mixed": "c_acctbal * 0.5 + c_nationkey * 10"}
CUSTOMER_META = {"bal": "numerical", "seg": "categorical", "nat": "numerical", "mixed": "numerical"}
CUSTOMER_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in CUSTOMER.items()) + " from customer"


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(*[f"{e} as {c}" for c, e in CUSTOMER.items()])


SKEW = "case when o_orderkey % 50 = 0 then 'rare' when o_orderkey % 5 = 0 then 'mid' when o_orderkey % 7 = 0 then null else 'common' end"


def skewed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", f"{SKEW} as cls", "o_orderstatus as st")


def h(key: str, number: str = "0", seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {key}, '{number}')), 1, 8))::bigint)"


ECDF_SQL = f"""with p as ({PAIR_SQL}), u as (
  {" union all ".join(f"select '{c}' as col, {c}::double + 0.0 as value, side from p where {c} is not null" for c in NUMBERS)}),
c as (select col, value, sum((side = 'real')::int) r, sum((side = 'synth')::int) s from u group by 1, 2),
e as (select col, value, sum(r) over w / sum(r) over (partition by col) as fr, sum(s) over w / sum(s) over (partition by col) as fs,
  lead(value) over (partition by col order by value) as nxt from c window w as (partition by col order by value rows unbounded preceding))"""
TV_SQL = f"""t as (select coalesce(sum(case when side = 'real' then 1 end), 0) r, coalesce(sum(case when side = 'synth' then 1 end), 0) s, flag from ({PAIR_SQL}) where flag is not null group by flag),
tv as (select 1 - 0.5 * sum(abs(r / (select sum(r) from t) - s / (select sum(s) from t))) as value from t)"""


# sources and columns


@query("select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by 1")
def io1_read_table(spark, d):
    return read_table(spark, f"{d}/lineitem.parquet", "parquet", drop_first=True).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("select x as imputation, y as generator, count(*) as n, sum(s_suppkey)::bigint as keys from supplier, (values ('mi', 'real'), ('knn', 'CART')) v(x, y) group by 1, 2")
def io2_write_datasets(spark, d):
    path, df = f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}", table(spark, d, "supplier")
    write_datasets(df, path, "mi", "real")
    write_datasets(df, path, "knn", "CART")
    return spark.read.parquet(path).groupBy("imputation", "generator").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys"))


@query("""select 'flags' as report, l_returnflag as name, count(*) as n, round(avg(l_quantity), 4) as mean from lineitem group by 2
union all select 'modes', o_orderpriority, count(*), round(avg(o_shippriority_), 4) from (select o_orderpriority, o_totalprice / 1000 as o_shippriority_ from orders) group by 2""")
def io3_write_report(spark, d):
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    frames = {
        "flags": table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean")),
        "modes": table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("o_totalprice") / 1000).alias("mean")),
    }
    write_report(frames, path, "csv")
    back = [spark.read.option("header", True).schema("name string, n long, mean double").csv(f"{path}/{k}").withColumn("report", F.lit(k)) for k in frames]
    return back[0].unionByName(back[1]).select("report", "name", "n", F.round("mean", 4).alias("mean"))


@query("select c_custkey as c_key, c_name as c__name__x, c_acctbal as acct_bal from customer")
def pr1_sanitize(spark, d):
    return schema.sanitize_columns(table(spark, d, "customer").selectExpr("c_custkey as ` c-key `", "c_name as `_c. name (x)`", "c_acctbal as `acct/bal_`"))


@query("select s_suppkey, s_nationkey from supplier")
def pr2_drop_by_index(spark, d):
    return schema.drop_by_index(table(spark, d, "supplier"), [1, 3, 99])


_EVENTS = [("event_id", "numerical"), ("ts", "categorical"), ("user_id", "numerical"), ("event_type", "categorical"), ("value", "numerical"), ("props", "categorical"), ("late", "categorical")]


@query("with e as (select *, value > 50 as late from events) " + " union all ".join(f"select '{c}' as name, '{k}' as kind, count({c}) as n, count(distinct {c}) as n_distinct from e" for c, k in _EVENTS))
def pr3_infer_schema(spark, d):
    df = table(spark, d, "events").withColumn("late", F.col("value") > 50)
    kinds = schema.infer_schema(df)
    row = df.agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(kinds) for n, f in (("n", F.count), ("d", F.count_distinct))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("n_distinct")) for i, (c, k) in enumerate(kinds.items())])))


@query("""select 'p_partkey' as name, 'primary_key' as kind, count(p_partkey) as n from part union all select 'p_brand', 'categorical', count(p_brand) from part
union all select 'p_size', 'categorical', count(p_size) from part union all select 'ratio', 'numerical', count(p_retailprice / p_size) from part""")
def pr4_align_schema(spark, d):
    parts = table(spark, d, "part")
    base = schema.infer_schema(parts) | {"p_partkey": "primary_key"}
    df = parts.select("p_partkey", "p_brand", "p_size", (F.col("p_retailprice") / F.col("p_size")).alias("ratio"))
    kinds = schema.align_schema(df, base, {"p_size": "categorical"})
    return df.agg(*[F.count(c).alias(c) for c in kinds]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind"), F.col(c).alias("n")) for c, k in kinds.items()])))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def pr5_duplicate_keys(spark, d):
    return schema.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""select l_orderkey, l_linenumber, round(l_extendedprice / l_quantity + 3e-7, 2) as unit, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + 3e-7, 1) as charge,
l_partkey - 7.0 * floor(l_partkey / 7.0) as m, -l_partkey - 7.0 * floor(-l_partkey / 7.0) as neg, l_quantity * l_quantity as sq from lineitem""")
def pr6_formulas(spark, d):
    df = expr.add_formulas(table(spark, d, "lineitem"), {"unit": "5/4", "charge": "c5 * (1.0 - 6) * (1.0 + c7)", "m": "c1 % 7.0", "neg": "-c1 % 7.0", "sq": "c4 ** 2.0", "bad": "__import__('os')"})
    return rounded(df.withColumns({"charge": F.round(F.col("charge") + 3e-7, 1), "unit": F.round(F.col("unit") + 3e-7, 2)}).select("l_orderkey", "l_linenumber", "unit", "charge", "m", "neg", "sq"))


@query(f"""with c as ({CUSTOMER_SQL}), m as (select median(bal) b, (select seg from c where seg is not null group by seg order by count(*) desc, seg limit 1) s from c)
select k::double as k, round(coalesce(bal, b), 6) as bal, coalesce(seg, s) as seg from c, m""")
def pr7_drop_indicators(spark, d):
    marked = impute.add_missing_indicators(customers(spark, d).select("k", "bal", "seg"))
    return rounded(schema.drop_indicators(marked, schema.infer_schema(marked))[0])


# constraints and gates


@query(f"""with p as ({PAIR_SQL}), b as (select min(qty) a, max(qty) b, min(price) c, max(price) d, min(disc) e, max(disc) f, min(cost) g, max(cost) h from p where side = 'real')
select count(*) as kept from p, b where side = 'synth' and qty between a and b and price between c and d and disc between e and f and cost between g and h""")
def fi1_auto_bounds(spark, d):
    real, syn = pair(spark, d)
    return expr.drop_violators(syn, expr.auto_bounds(real)).agg(F.count(F.lit(1)).alias("kept"))


# text beside numbers: never equal, and without an order; those that have none are left out
UNLIKE = ["c8 != 5", "not (c4 == 'x')", "c8 in ['A', 'R', 3] or c2 != 'x' and c8 == 'N'", "c8 < 5", "c4 >= 'x'", "c8 * 2 > 1", "c4 + c8 != 1", "c10 > '1970-01-01'", "c10 != 'never'", "not c10 in ['never', 7]", "c0 < 100000000000000000000"]
# the last but one of these is 0/0 where the discount is 0, and so false there; the last isn't a rule and is left out
RULES = ["0 <= c4 < 45", "not (c6 > 0.09) or c8 == 'A'", "c3 in [1, 2, 3, 4, 5, 6]", "c5 / c4 > 900 & c7 != 0.08", "c6 / c6 >= 1 | c4 > 40", "c0 = 3", *UNLIKE]
RULES_SQL = """(0 <= l_quantity and l_quantity < 45) and (not (l_discount > 0.09) or l_returnflag = 'A') and l_linenumber in (1, 2, 3, 4, 5, 6)
and l_extendedprice / l_quantity > 900 and l_tax != 0.08 and (l_discount != 0 or l_quantity > 40)"""


@query(f"select l_returnflag, count(*) as n from lineitem where {RULES_SQL} group by 1")
def fi3_drop_violators(spark, d):
    return expr.drop_violators(table(spark, d, "lineitem"), RULES).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(f"select round(1 - count(*) filter ({RULES_SQL}) / count(*), 6) as violation_rate from lineitem")
def fi4_violation_rate(spark, d):
    return rounded(expr.violation_rate(table(spark, d, "lineitem"), RULES))


@query("""with t as (select min(o_totalprice) a, max(o_totalprice) b, min(o_custkey) c, max(o_custkey) e from orders where o_orderkey % 5 != 0)
select o_orderkey, o_totalprice from orders, t where o_orderkey % 5 = 0 and o_totalprice between a and b and o_custkey between c and e and o_totalprice >= 50000""")
def fi5_fold_constraints(spark, d):
    cols = table(spark, d, "orders").select("o_totalprice", "o_custkey", "o_orderkey")
    train, test = (cols.where(f"o_orderkey % 5 {op} 0") for op in ("!=", "="))
    rules = expr.fold_constraints(train.drop("o_orderkey"), ["c0 >= 50000"])
    return expr.drop_violators(test, rules).select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_size::double as t from part where p_partkey % 3 != 0")
def fi6_with_target(spark, d):
    return with_target(table(spark, d, "part").selectExpr("p_partkey", "case when p_partkey % 3 = 0 then 'none' else cast(p_size as string) end as t"), "t", numeric=True)


@query("""with r as (select l_quantity a, l_extendedprice b from lineitem where l_orderkey % 2 = 0), m as (select avg(a) ma, avg(b) mb, var_samp(a) va, var_samp(b) vb, covar_samp(a, b) c from r)
select l_returnflag, count(*) as n from lineitem, m where l_orderkey % 2 = 1 and
((l_quantity - ma) ** 2 * vb - 2 * (l_quantity - ma) * (l_extendedprice * 1.3 - mb) * c + (l_extendedprice * 1.3 - mb) ** 2 * va) / (va * vb - c * c) <= -2 * ln(0.1) group by 1""")
def fi7_covariance_outliers(spark, d):
    rows = table(spark, d, "lineitem")
    real = rows.where("l_orderkey % 2 = 0").select("l_quantity", "l_extendedprice")
    syn = rows.where("l_orderkey % 2 = 1").selectExpr("l_returnflag", "l_quantity", "l_extendedprice * 1.3 as l_extendedprice")
    meta = {"l_quantity": "numerical", "l_extendedprice": "numerical"}
    return privacy.drop_covariance_outliers(real, syn, meta, 0.9).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select l_suppkey, avg(l_discount) violation_rate, avg(l_quantity) corr_score from lineitem group by 1)
select l_suppkey, violation_rate <= 0.05 and corr_score >= 25 as passed, case when violation_rate > 0.05 then 1 else 0 end + case when corr_score < 25 then 1 else 0 end as n from r""")
def fi9_threshold_gate(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(metrics.exact_mean("l_discount").alias("violation_rate"), metrics.exact_mean("l_quantity").alias("corr_score"))
    return gate.threshold_gate(rows, {"violation_rate": 0.05, "corr_score": 25.0}).select("l_suppkey", "passed", F.size("failures").alias("n"))


# aggregations and reports


@query(f"select cls, count(*) as n from (select {SKEW} as cls from orders) where cls is not null group by 1")
def ag1_class_counts(spark, d):
    return sample.class_counts(skewed(spark, d), "cls")


FOLDS = {"Dataset": "'lineitem'", "Imputation": "l_returnflag", "Synthetic_Model": "l_linestatus", "Classifier": "case when l_linenumber % 2 = 0 then 'RF' else 'GB' end", "Evaluation": "case when l_partkey % 2 = 0 then 'Real' else 'Mixed' end", "Regressor": "case when l_linenumber % 2 = 0 then 'RF' else 'GB' end", "Generator": "case when l_linestatus = 'O' then 'CART' else 'copula' end", "Fold": "cast(l_suppkey % 15 as int)"}
VALUES = {"accuracy": "l_discount * 5", "balanced_accuracy": "l_tax * 5", "f1_macro": "l_quantity / 60", "roc_auc": "case when l_suppkey % 15 = 3 then null else l_discount + l_tax end", "mae": "l_quantity", "rmse": "l_quantity * 2", "r2": "l_discount", "mape": "l_tax"}
FOLDS_SQL = "select " + ", ".join(f"{e} as {c}" for c, e in FOLDS.items()) + ", " + ", ".join(f"avg({e}) as {c}" for c, e in VALUES.items()) + " from lineitem group by all"


def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in FOLDS.items()], *[f"cast({e} as double) as {c}" for c, e in VALUES.items()])
    return rows.groupBy(*FOLDS).agg(*[F.avg(c).alias(c) for c in VALUES])


def summary_sql(keys: list[str], values: list[str], source: str = FOLDS_SQL) -> str:
    each = ", ".join(f"round(avg({m}), 6) as {m}_mean, round(stddev_samp({m}), 6) as {m}_std" for m in values)
    return f"select {', '.join(keys)}, {each}, count(*) as folds from ({source}) group by {', '.join(keys)}"


@query(summary_sql(["Imputation", "Synthetic_Model", "Classifier"], report.CLASSIFICATION))
def ag2_summarize_classification(spark, d):
    return rounded(report.summarize_classification(fold_scores(spark, d)))


@query(summary_sql(["Dataset", "Imputation", "Synthetic_Model", "Evaluation", "Regressor"], report.REGRESSION))
def ag3_summarize_regression(spark, d):
    return rounded(report.summarize_regression(fold_scores(spark, d)))


@query(f"""with f as ({FOLDS_SQL}), g as (select Imputation, avg(r2) as r2, avg(mae) as mae from f where lower(Generator) = 'copula' group by 1)
select 'r2' as metric, Imputation as imputation, round(r2, 6) as value from g where (select count(*) from g) >= 2 union all select 'mae', Imputation, round(mae, 6) from g where (select count(*) from g) >= 2""")
def ag4_compare_imputations(spark, d):
    return rounded(report.compare_imputations(fold_scores(spark, d), "Copula", ["r2", "mae"]))


@query(f"""select Synthetic_Model, Regressor, Imputation, round(coalesce(avg(mae) filter (Evaluation = 'Real'), 0), 6) as Real, round(coalesce(avg(mae) filter (Evaluation = 'Mixed'), 0), 6) as Mixed
from ({FOLDS_SQL}) group by 1, 2, 3""")
def ag5_compare_regression(spark, d):
    return rounded(report.compare_regression(fold_scores(spark, d), "mae", ["Real", "Mixed"]))


@query("select l_orderkey, l_linenumber, round_even(l_tax * 12.5, 0) as x, round_even(l_quantity / 8, 2) as y, 'cls' as Target_Column from lineitem")
def ag6_round_report(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_tax * 12.5D as x", "l_quantity / 8 as y")
    return report.round_report(df.withColumn("x", F.bround("x", 0)), 2, "cls")


# windows, samples, folds


@query(ECDF_SQL + " select col as \"column\", round(sum(fr), 4) as sum_real, round(sum(fs), 4) as sum_synth, count(*) as n, round(sum(nxt - value), 4) as span from e group by 1")
def wi1_ecdf_pair(spark, d):
    cdf = metrics.ecdf_pair(*pair(spark, d), NUMBERS)
    return rounded(cdf.groupBy("column").agg(F.sum("real_cdf").alias("sum_real"), F.sum("synth_cdf").alias("sum_synth"), F.count(F.lit(1)).alias("n"), F.sum(F.col("following") - F.col("value")).alias("span")), 4)


@query("select o_orderkey, greatest(ceil((row_number() over (order by o_totalprice, o_orderkey) - 1) * 10 / (count(*) over () - 1)) - 1, 0)::int as o_totalprice from orders")
def wi2_rank_deciles(spark, d):
    return sample.rank_deciles(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"])


@query(f"select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by {h('c_custkey')}, c_custkey) as rn from customer")
def wi3_number_within(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment").withColumn("h", draw(42, ["c_custkey"]))
    return number_within(df, ["c_mktsegment"], ["h", "c_custkey"], spread="h").drop("h")


def resample_sql(rows: str, group: str, key: str, seed: int = 42) -> str:
    return f"""with r as ({rows}), n as (select {group} g, count(*) n from r group by 1), m as (select max(n) m from n),
numbered as (select *, row_number() over (partition by {group} order by {h(key, "row", seed)}, {key}) rn from r),
draws as (select g, n, unnest(range(1, (select m from m) + 1)) draw from n),
picks as (select g, draw, 1 + floor(('0x' || substr(md5(concat_ws('|', '{seed}', g, draw)), 1, 8))::bigint / 4294967296.0 * n) rn from draws)
"""


@query(resample_sql(f"select o_orderkey, {SKEW} as cls from orders where {SKEW} is not null", "cls", "o_orderkey") + "select o_orderkey, cls, draw from numbered join picks on cls = g and numbered.rn = picks.rn")
def sa1_oversample(spark, d):
    return sample.oversample(skewed(spark, d), "cls", ["o_orderkey"]).select("o_orderkey", "cls", "draw")


@query(resample_sql(f"select o_orderkey, {SKEW} as cls, o_orderstatus as st, '[\"' || coalesce({SKEW}, 'nan') || '\",\"' || o_orderstatus || '\"]' as grp from orders", "grp", "o_orderkey") + "select o_orderkey, cls, st, draw from numbered join picks on grp = g and numbered.rn = picks.rn")
def sa2_oversample_multi(spark, d):
    return sample.oversample_multi(skewed(spark, d), {"cls": "categorical", "st": "categorical", "o_totalprice": "numerical"}, ["o_orderkey"]).select("o_orderkey", "cls", "st", "draw")


@query(f"""with r as (select o_orderkey, row_number() over (order by {h('o_orderkey', 'row')}, o_orderkey) rn from orders), n as (select count(*) n from r),
picks as (select i as draw, 1 + floor({h('i', 'draw')} / 4294967296.0 * n) as rn from n, range(5000) t(i)) select o_orderkey, draw from r join picks using (rn)""")
def sa3_bootstrap(spark, d):
    return sample.bootstrap(table(spark, d, "orders").select("o_orderkey"), 5000, ["o_orderkey"])


@query(" union all ".join(f"select o_orderkey, {r} as repeat, ((row_number() over (order by {h('o_orderkey', str(r))}, o_orderkey) - 1) % 5)::int as fold from orders" for r in range(2)))
def sa4_kfold(spark, d):
    return sample.kfold(table(spark, d, "orders").select("o_orderkey"), 5, 2, ["o_orderkey"])


@query(" union all ".join(f"select o_orderkey, cls, {r} as repeat, ((row_number() over (partition by cls order by {h('o_orderkey', str(r))}, o_orderkey) - 1) % 5)::int as fold from (select *, {SKEW} as cls from orders) where cls is not null" for r in range(2)))
def sa5_stratified_kfold(spark, d):
    return sample.stratified_kfold(skewed(spark, d).select("o_orderkey", "cls"), "cls", 5, 2, ["o_orderkey"])


@query(f"select o_orderkey, cls, row_number() over (partition by cls order by {h('o_orderkey', 'split')}, o_orderkey) > round_even(count(*) over (partition by cls) * 0.75, 0) as is_test from (select *, {SKEW} as cls from orders)")
def sa6_stratified_split(spark, d):
    return sample.stratified_split(skewed(spark, d).select("o_orderkey", "cls"), "cls", 0.25, ["o_orderkey"])


@query(f"select o_orderkey from orders order by {h('o_orderkey', 'take')}, o_orderkey limit 1000")
def sa8_take_exact(spark, d):
    return sample.take_exact(table(spark, d, "orders").select("o_orderkey"), 1000, [draw(42, ["o_orderkey"], "take"), "o_orderkey"])


@query("select s_suppkey as k, s_acctbal as bal, null::varchar as seg, 'real' as source from supplier union all select c_custkey, c_acctbal, c_mktsegment, 'synthetic' from customer")
def se1_augment(spark, d):
    real = table(spark, d, "supplier").selectExpr("s_suppkey as k", "s_acctbal as bal")
    return sample.augment(real, table(spark, d, "customer").selectExpr("c_custkey as k", "c_acctbal as bal", "c_mktsegment as seg")).select("k", "bal", "seg", "source")


@query("select distinct l_quantity, l_discount, l_returnflag from lineitem")
def se2_distinct_rows(spark, d):
    return sample.distinct_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag"))


# imputation


@query(f"""with c as ({CUSTOMER_SQL}), m as (select median(bal) b, (select seg from c where seg is not null and k % 5 != 0 group by seg order by count(*) desc, seg limit 1) s from c where k % 5 != 0)
select k, round(coalesce(bal, b), 6) as bal, coalesce(seg, s) as seg from c, m""")
def im1_impute_simple(spark, d):
    df = customers(spark, d).select("k", "bal", "seg")
    a, b = impute.impute_simple(df.where("k % 5 != 0"), df.where("k % 5 = 0"), keep=["k"])
    return rounded(a.unionByName(b))


@query(f"""with c as ({CUSTOMER_SQL}), m as (select median(bal) b, (select seg from c where seg is not null and k % 4 != 0 group by seg order by count(*) desc, seg limit 1) s from c where k % 4 != 0)
select k::double as k, round(coalesce(bal, b), 6) as bal, coalesce(seg, s) as seg, nat % 3 as target, k % 4 = 0 as test from c, m""")
def im7_impute_fold(spark, d):
    # without another numerical column the categories come from the mode, so the whole fold has an SQL form
    df = customers(spark, d).select("k", "bal", "seg", (F.col("nat") % 3).alias("target"))
    meta = {"k": "primary_key", "seg": "categorical", "target": "numerical"}
    train, test = impute.impute_fold(df.where("k % 4 != 0"), df.where("k % 4 = 0"), meta, "mi", "target", "k")
    out = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return rounded(out.withColumn("k", F.col("k").cast("double")))


@query(f"""with c as ({CUSTOMER_SQL}), m as (select median(bal) b, (select seg from c where seg is not null group by seg order by count(*) desc, seg limit 1) s from c)
select k::double as k, round(coalesce(bal, b), 6) as bal, coalesce(seg, s) as seg, bal is null as missingindicator_bal, seg is null as missingindicator_seg from c, m""")
def im2_missing_indicators(spark, d):
    return rounded(impute.add_missing_indicators(customers(spark, d).select("k", "bal", "seg")))


@query()
def im3_categorical_forest(spark, d):
    return impute.impute_categorical_rf(customers(spark, d), meta=CUSTOMER_META)[0].select("k", "seg")


@query()
def im4_knn(spark, d):
    return rounded(impute.impute_knn(customers(spark, d), meta=CUSTOMER_META, key="k")[0], 4)


@query()
def im5_iterative(spark, d):
    return rounded(impute.impute_iterative(customers(spark, d), meta=CUSTOMER_META)[0], 4)


@query(f"with c as ({CUSTOMER_SQL}), r as (select seg, dense_rank() over (order by seg) - 1.0 as code from c where seg is not null group by seg) select k, coalesce(r.code, -1)::double as code, c.seg as back from c left join r on c.seg = r.seg")
def im6_encode_decode(spark, d):
    coded, lists = features.encode_categories(customers(spark, d).select("k", "seg"), ["seg"])
    return features.decode_categories(coded.select("k", F.coalesce("seg", F.lit(-1.0)).alias("code"), "seg"), lists).withColumnRenamed("seg", "back")


# features


@query(f"""with c as (select k, coalesce(seg, '__MISSING_TARGET__') as t from ({CUSTOMER_SQL})) select k, (select count(distinct t) from c x where x.t < c.t)::double as t from c""")
def fe1_encode_target(spark, d):
    df = customers(spark, d).selectExpr("k", "seg as t")
    a, b, _ = features.encode_target(df.where("k % 5 != 0"), df.where("k % 5 = 0"), "t")
    return a.unionByName(b)


@query(f"""with c as ({CUSTOMER_SQL}), m as (select median(bal) b, median(nat) n, (select seg from c where seg is not null and k % 5 != 0 group by seg order by count(*) desc, seg limit 1) s from c where k % 5 != 0),
f as (select k, coalesce(bal, b) bal, coalesce(nat, n) nat, coalesce(seg, s) seg from c, m) select k, round(bal, 6) as bal, nat, (seg = 'BUILDING')::int as seg_BUILDING, (seg = 'MACHINERY')::int as seg_MACHINERY from f""")
def fe2_prepare_features(spark, d):
    df = customers(spark, d).select("k", "bal", "seg", "nat")
    a, b = features.prepare_features(df.where("k % 5 != 0"), df.where("k % 5 = 0"), "k")
    return rounded(a.unionByName(b).select("k", "bal", "nat", "seg_BUILDING", "seg_MACHINERY"))


@query(f"""with p as ({PAIR_SQL}), m as (select avg(qty) a, stddev_samp(qty) b, avg(price) c, stddev_samp(price) d from p where side = 'real')
select flag, round(sum(coalesce((qty - a) / b, 0)), 4) as qty, round(sum(coalesce((price - c) / d, 0)), 4) as price from p, m where side = 'synth' group by 1""")
def fe3_standardize(spark, d):
    real, syn = pair(spark, d)
    return rounded(metrics.standardize_by(real, syn, ["qty", "price"]).groupBy("flag").agg(F.sum("qty").alias("qty"), F.sum("price").alias("price")), 4)


@query(f"select round(sum(round_even(qty + 0.25, 0)), 4) as qty, round(sum(round_even(disc / 3, 4)), 4) as disc from ({PAIR_SQL}) where side = 'synth'")
def fe4_align_precision(spark, d):
    real, syn = pair(spark, d)
    _, b = features.align_precision(real, syn.withColumns({"qty": F.col("qty") + 0.25, "disc": F.col("disc") / 3}), ["qty", "disc"])
    return rounded(b.agg(F.sum("qty").alias("qty"), F.sum("disc").alias("disc")), 4)


@query(f"""with p as ({PAIR_SQL}), m as (select avg(qty) q, (select flag from p where flag is not null group by flag order by count(*) desc, flag limit 1) f from p)
select coalesce(flag, f) as flag, round(sum(coalesce(qty, q)), 4) as qty, count(*) as n from p, m group by 1""")
def fe5_fill_union(spark, d):
    real, syn = pair(spark, d)
    return rounded(features.fill_union(real.unionByName(syn).select("qty", "flag")).groupBy("flag").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n")), 4)


@query("""with f as (select o_orderpriority p, count(*) / (select count(*) from orders) as f from orders group by 1)
select round(f, 8) as f, (select min(p) from f g where g.f = f.f) as back, count(*) as n from orders join f on o_orderpriority = p group by f.f, back""")
def fe6_frequency_codes(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderpriority as p")
    coded = features.frequency_encode(df, "p").withColumnRenamed("p", "f")
    back = features.frequency_decode(coded.withColumn("back", F.col("f")), "back", features.frequencies(df, "p"))
    return back.groupBy(F.round("f", 8).alias("f"), "back").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, epoch_us(ts) / 1e6 as secs, (value > 0)::int as up, ts as back from events")
def fe8_numeric_types(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", "ts", "value > 0 as up")
    n = features.to_numeric_types(df)
    back = features.from_numeric_types(n, df.schema).select("event_id", F.col("ts").alias("back"))
    return n.select("event_id", F.col("ts").alias("secs"), "up").join(back, "event_id")


@query("select round_even(o_totalprice, 0)::bigint as o_totalprice, o_orderkey from orders")
def fe9_restore_types(spark, d):
    df = table(spark, d, "orders").selectExpr("o_totalprice", "cast(o_orderkey as double) as o_orderkey")
    like = spark.createDataFrame([], "o_totalprice bigint, o_orderkey bigint").schema
    return features.restore_types(df, like)


# metrics


@query(f"""with p as ({PAIR_SQL}) select a, b, n, round(c, 4) as cov from (
{" union all ".join(f"select '{a}' a, '{b}' b, count(*) filter ({a} is not null and {b} is not null) n, covar_samp({a}, {b}) c from p where side = 'real'" for i, a in enumerate(NUMBERS) for b in NUMBERS[i:])})""")
def mx0_moments(spark, d):
    return rounded(metrics.pairwise_moments(pair(spark, d)[0], NUMBERS).select("a", "b", "n", "cov"), 4)


@query(ECDF_SQL + ' select col as "column", round(1 - max(abs(fr - fs)), 6) as value from e group by 1')
def mx1_ks_complement(spark, d):
    return rounded(metrics.ks_complement(*pair(spark, d), NUMBERS))


@query("with " + TV_SQL + " select 'flag' as \"column\", round(value, 6) as value from tv")
def mx2_tv_complement(spark, d):
    return rounded(metrics.tv_complement(*pair(spark, d), ["flag"]))


@query(ECDF_SQL + ", " + TV_SQL + ", x as (select col, 1 - max(abs(fr - fs)) as value from e group by 1 union all select 'flag', value from tv) select 'marginal' as metric, col as \"column\", round(value, 6) as value from x union all select 'Marginal', '', round(avg(value), 6) from x")
def mx3_marginals(spark, d):
    return rounded(metrics.marginals(*pair(spark, d), PAIR_META))


@query(f"""with p as ({PAIR_SQL}), b as (select {', '.join(f"min({c}) lo_{c}, max({c}) hi_{c}" for c in NUMBERS)} from p where side = 'real')
select round(({' + '.join(f"avg(coalesce({c} between lo_{c} and hi_{c}, false)::int)" for c in NUMBERS)}) / {len(NUMBERS)}, 6) as boundary_score from p, b where side = 'synth'""")
def mx4_boundary_adherence(spark, d):
    return rounded(metrics.boundary_adherence(*pair(spark, d), PAIR_META))


_pairs = [(a, b) for a in NUMBERS for b in NUMBERS if a != b]


@query(f"""with p as ({PAIR_SQL}), r as (select {', '.join(f"corr({a}, {b}) {a}_{b}" for a, b in _pairs)} from p where side = 'real'), s as (select {', '.join(f"corr({a}, {b}) {a}_{b}" for a, b in _pairs)} from p where side = 'synth')
select round(1 - ({' + '.join(f"abs(r.{a}_{b} - s.{a}_{b})" for a, b in _pairs)}) / {len(_pairs)}, 6) as corr_score from r, s""")
def mx5_correlation_similarity(spark, d):
    return rounded(metrics.correlation_similarity(*pair(spark, d), PAIR_META))


_all = [(a, b) for a in NUMBERS for b in NUMBERS]


@query(f"""with p as ({PAIR_SQL}), m as (select {', '.join(f"avg({c}) m_{c}, stddev_samp({c}) s_{c}" for c in NUMBERS)} from p where side = 'real'),
z as (select side, {', '.join(f"coalesce(({c} - m_{c}) / s_{c}, 0) {c}" for c in NUMBERS)} from p, m),
r as (select {', '.join(f"covar_samp({a}, {b}) {a}_{b}" for a, b in _all)} from z where side = 'real'), s as (select {', '.join(f"covar_samp({a}, {b}) {a}_{b}" for a, b in _all)} from z where side = 'synth')
select round(greatest(0, 1 - sqrt({' + '.join(f"(r.{a}_{b} - s.{a}_{b}) ** 2" for a, b in _all)}) / sqrt({' + '.join(f"r.{a}_{b} ** 2" for a, b in _all)})), 6) as cov_score from r, s""")
def mx6_covariance_similarity(spark, d):
    return rounded(metrics.covariance_similarity(*pair(spark, d), PAIR_META))


def parties(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers as a pair of tables."""
    return table(spark, d, "customer").selectExpr("c_custkey as ka", "c_acctbal / 1000 as x", "cast(c_nationkey as double) / 10 as y"), table(spark, d, "supplier").selectExpr("s_suppkey as kb", "s_acctbal / 1000 as x", "cast(s_nationkey as double) / 10 as y")


PARTIES_SQL = "a as (select c_custkey ka, c_acctbal / 1000 x, c_nationkey / 10 y from customer), b as (select s_suppkey kb, s_acctbal / 1000 x, s_nationkey / 10 y from supplier)"
PARTIES_META = {"x": "numerical", "y": "numerical"}


@query(f"""with {PARTIES_SQL}, m as (select avg(x) mx, stddev_samp(x) sx, avg(y) my, stddev_samp(y) sy from a), e as (select kb, sqrt(((a.x - b.x) / sx) ** 2 + ((a.y - b.y) / sy) ** 2) d from a, b, m),
n as (select kb, list_sort(min(d, 2)) l from e group by 1) select round(avg(l[1]), 6) as DCR_mean, round(min(l[1]), 6) as DCR_min, round(avg(l[1] / (l[2] + 1e-8)), 6) as NNDR_mean from n""")
def mx8_dcr_nndr(spark, d):
    a, b = parties(spark, d)
    return rounded(privacy.dcr_nndr(a, b, PARTIES_META, "ka", "kb"))


@query(ECDF_SQL + " select round(avg(w), 6) as wd_score from (select sum(abs(fr - fs) * (coalesce(nxt, value) - value)) w from e group by col)")
def mx9_wasserstein(spark, d):
    return rounded(metrics.wasserstein(*pair(spark, d), PAIR_META))


@query(f"""with {PARTIES_SQL}, xx as (select avg(exp(-0.5 * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2))) v from a p, a q), yy as (select avg(exp(-0.5 * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2))) v from b p, b q),
xy as (select avg(exp(-0.5 * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2))) v from a p, b q) select round(xx.v + yy.v - 2 * xy.v, 6) as mmd_score from xx, yy, xy""")
def mx10_mmd(spark, d):
    a, b = parties(spark, d)
    return rounded(privacy.mmd_rbf(a, b, PARTIES_META, "ka", "kb"))


@query(f"""with {PARTIES_SQL}, xx as (select avg(exp(-0.5 * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2))) v from a p, a q), yy as (select avg(exp(-0.5 * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2))) v from b p, b q),
xy as (select avg(exp(-0.5 * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2))) v from a p, b q) select true as near_exact from xx, yy, xy where xx.v + yy.v - 2 * xy.v >= 0""")
def mx10_mmd_features(spark, d):
    # the error of random features against all pairs
    a, b = parties(spark, d)
    exact = privacy.mmd_rbf(a, b, PARTIES_META, "ka", "kb")
    near = privacy.mmd_features(a, b, PARTIES_META, drop=("ka", "kb")).withColumnRenamed("mmd_score", "near")
    return exact.crossJoin(F.broadcast(near)).select((F.abs(F.col("near") - F.col("mmd_score")) <= 0.05).alias("near_exact"))


@query(f"""with {PARTIES_SQL}, r as (select avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) c from a), s as (select avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) c from b)
select round((r.mx - s.mx) ** 2 + (r.my - s.my) ** 2 + r.vx + r.vy + s.vx + s.vy - 2 * sqrt(r.vx * s.vx + 2 * r.c * s.c + r.vy * s.vy + 2 * sqrt((r.vx * r.vy - r.c ** 2) * (s.vx * s.vy - s.c ** 2))), 6) as fd_score from r, s""")
def mx11_frechet(spark, d):
    return rounded(metrics.frechet(*parties(spark, d), PARTIES_META))


@query()
def mx12_propensity(spark, d):
    a, b = parties(spark, d)
    return rounded(detect.propensity_score(a.withColumnRenamed("ka", "k"), b.withColumnRenamed("kb", "k"), PARTIES_META, ["k"]))


@query()
def mx13_log_cluster(spark, d):
    return rounded(detect.log_cluster(*parties(spark, d), PARTIES_META), 4)


PREDICTED = "select l_linenumber as g, l_returnflag as label, case when l_discount < 0.03 then 'A' when l_discount < 0.07 then 'N' else 'R' end as prediction from lineitem"


@query(f"""with p as ({PREDICTED}), k as (select g, label k from p union select g, prediction from p), c as (select k.g, k.k, count(*) filter (label = k.k) t, count(*) filter (prediction = k.k) s, count(*) filter (label = k.k and prediction = k.k) x from k join p on p.g = k.g group by 1, 2)
select g, round(sum(x) / sum(t), 6) as accuracy, round(avg(x / t) filter (t > 0), 6) as balanced_accuracy, round(avg(2 * x / (t + s)), 6) as f1_macro from c group by 1""")
def mx14_classification_scores(spark, d):
    pred = table(spark, d, "lineitem").selectExpr("l_linenumber as g", "l_returnflag as label", "case when l_discount < 0.03 then 'A' when l_discount < 0.07 then 'N' else 'R' end as prediction")
    return rounded(metrics.classification_scores(pred, ["g"]))


@query("""with r as (select l_linenumber g, l_quantity > 25 p, rank() over w + (count(*) over (partition by l_linenumber, l_extendedprice) - 1) / 2 as r from lineitem window w as (partition by l_linenumber order by l_extendedprice))
select g, round((sum(r) filter (p) - count(*) filter (p) * (count(*) filter (p) + 1) / 2) / (count(*) filter (p) * count(*) filter (not p)), 6) as roc_auc from r group by 1""")
def mx14_roc_auc(spark, d):
    pred = table(spark, d, "lineitem").selectExpr("l_linenumber as g", "l_quantity > 25 as positive", "l_extendedprice as score")
    return rounded(metrics.roc_auc(pred, ["g"]))


@query("""select o_orderpriority as g, round(avg(abs(p - y)), 4) as mae, round(sqrt(avg((p - y) ** 2)), 4) as rmse, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) as r2, round(100 * avg(abs(p - y) / greatest(abs(y), 1e-8)), 4) as mape
from (select *, o_totalprice y, o_totalprice * 0.9 + 1000 p from orders) group by 1""")
def mx15_regression_scores(spark, d):
    pred = table(spark, d, "orders").selectExpr("o_orderpriority as g", "o_totalprice as label", "o_totalprice * 0.9D + 1000 as prediction")
    return metrics.regression_scores(pred, ["g"]).select("g", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mape", 4).alias("mape"))


@query(f"""with {PARTIES_SQL}, bx as (select min(x) a, max(x) b, min(y) c, max(y) d from a), r as (select corr(x, y) c from a), s as (select corr(x, y) c from b)
select round((avg((x between bx.a and bx.b)::int) + avg((y between bx.c and bx.d)::int)) / 2, 6) as boundary_score, round(1 - 2 * abs((select c from r) - (select c from s)) / 2, 6) as corr_score, round(1 - avg((x >= 0)::int), 6) as violation_rate,
'CART_1' as Model, 'mi' as Imputation, 'CART' as Generator from b, bx""")
def mx17_compare_all(spark, d):
    a, b = parties(spark, d)
    out = gate.compare_all("mi", a.select("x", "y", "ka"), {"CART_1": b.select("x", "y", "kb")}, PARTIES_META, ["c0 >= 0"], ("ka", "kb"), ["boundary_score", "corr_score", "violation_rate"])
    return rounded(out)


@query(f"""with {PARTIES_SQL}, bx as (select min(x) a, max(x) b, min(y) c, max(y) d from a), r as (select corr(x, y) c, avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) cv, stddev_samp(x) sx, stddev_samp(y) sy from a),
s as (select corr(x, y) c, avg(x) mx, avg(y) my, var_samp(x) vx, var_samp(y) vy, covar_samp(x, y) cv from b),
e as (select kb, sqrt(((a.x - b.x) / sx) ** 2 + ((a.y - b.y) / sy) ** 2) d from a, b, r), n as (select kb, list_sort(min(d, 2)) l from e group by 1)
select round((select avg((x between bx.a and bx.b)::int) + avg((y between bx.c and bx.d)::int) from b, bx) / 2, 3) as boundary_score, round(1 - abs(r.c - s.c), 3) as corr_score, (select round(1 - avg((x >= 0)::int), 3) from b) as violation_rate,
(select round(avg(l[1]), 3) from n) as DCR_mean, (select round(min(l[1]), 3) from n) as DCR_min, (select round(avg(l[1] / (l[2] + 1e-8)), 3) from n) as NNDR_mean,
round((r.mx - s.mx) ** 2 + (r.my - s.my) ** 2 + r.vx + r.vy + s.vx + s.vy - 2 * sqrt(r.vx * s.vx + 2 * r.cv * s.cv + r.vy * s.vy + 2 * sqrt((r.vx * r.vy - r.cv ** 2) * (s.vx * s.vy - s.cv ** 2))), 3) as fd_score from r, s""")
def mx16_compare_closed_forms(spark, d):
    wanted = ["boundary_score", "corr_score", "violation_rate", "DCR_mean", "DCR_min", "NNDR_mean", "fd_score"]
    return rounded(gate.compare_tables(*parties(spark, d), PARTIES_META, ["c1 >= 0"], ("ka", "kb"), wanted), 3)


@query()
def mx16_compare_tables(spark, d):
    return rounded(gate.compare_tables(*parties(spark, d), PARTIES_META, ["c1 >= 0"], ("ka", "kb")), 3)


@query()
def mx18_pca_projection(spark, d):
    out, _ = detect.pca_projection(*pair(spark, d), PAIR_META)
    return rounded(out, 4)


# generation and modelling


@query("""with x as (select l_quantity x from lineitem), n as (select count(*) n, stddev_pop(x) s, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) i from x)
select round(0.9 * n ** -0.2 * least(s, i / 1.34), 6) as bandwidth from n""")
def ge4_bandwidth(spark, d):
    s = synth.smoothing(table(spark, d, "lineitem"), "l_quantity")
    return spark.range(1).select(F.round(F.lit(s["bandwidth"]), 6).alias("bandwidth"))


@query("""with x as (select l_quantity v from lineitem union all select 1e6 from (select 1) t), n as (select v from x where v != 1e6)
select 'top' as kind, null::double as mode, 1e6 as top, round(0.9 * count(*) ** -0.2 * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34), 6) as bandwidth from n
union all select 'repeated top', null, null, round(0.9 * count(*) ** -0.2 * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34), 6) from (select v from x union all select 1e6)
union all select 'absent top', null, 2e6, round(0.9 * count(*) ** -0.2 * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34), 6) from x
union all select 'mode', 0, null, round(0.9 * count(*) ** -0.2 * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34), 6) from (select l_quantity v from lineitem where l_orderkey % 5 = 0)""")
def ge4_smoothing_cases(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("v"))
    far = spark.range(1).select(F.lit(1e6).alias("v"))
    once = items.select("v").union(far)
    cases = {"top": once, "repeated top": once.union(far), "mode": items.select(F.when(F.col("l_orderkey") % 5 == 0, F.col("v")).otherwise(0.0).alias("v"))}
    rows = [(k, *[s[n] for n in ("mode", "top", "bandwidth")]) for k, df in cases.items() for s in [synth.smoothing(df, "v")]]
    absent = synth.smoothing(once, "v", 2e6)  # no drawn row has the real table's largest value: none is left out
    rows.append(("absent top", absent["mode"], absent["top"], absent["bandwidth"]))
    return rounded(spark.createDataFrame(rows, "kind string, mode double, top double, bandwidth double"))


@query()
def ge5_cart(spark, d):
    real = customers(spark, d).drop("k")
    return synth.synthesize_cart(real, gate.target_rows(real.count()), CUSTOMER_META, seed=7)


@query()
def ge6_copula(spark, d):
    real = customers(spark, d).drop("k")
    return synth.synthesize_copula(real, gate.target_rows(real.count()), CUSTOMER_META, seed=7)


@query()
def ge7_generate_until(spark, d):
    real = customers(spark, d).drop("k")
    path = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    limits = {"Marginal": 0.7, "boundary_score": 0.7, "corr_score": 0.4}
    return gate.generate_until(synth.copula_generator(CUSTOMER_META), real, real, gate.target_rows(real.count()), CUSTOMER_META, expr.auto_bounds(real), path, limits)


class EveryNth:
    """A generator of a user's own: rows of the real table, as they are. Counts its calls."""

    def __init__(self, fail: int = 0):
        self.calls, self.fail = 0, fail

    def __call__(self, real: DataFrame, n: int, seed: int) -> DataFrame:
        self.calls += 1
        if self.calls <= self.fail:
            raise RuntimeError("not yet")
        return real.orderBy("c_custkey").limit(n)


@query("select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal >= 0 order by c_custkey limit 500")
def ge9_own_generator(spark, d):
    # a batch is as large as the table, so that the accepted rows have an SQL form: all that meet the constraint, trimmed to 500
    real = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").where("c_acctbal >= 0")
    path = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    settings = gate.Settings(min_batch=500, max_batch=500)
    return gate.generate_until(EveryNth(), real, real, 500, schema.infer_schema(real), ["c2 >= 0"], path, settings=settings)


@query("select m as model, count(*) as n, sum(c_custkey)::bigint as keys from (select c_custkey from customer where c_acctbal >= 0 order by c_custkey limit 500), (values ('late'), ('steady')) v(m) group by 1")
def ge8_run_generators(spark, d):
    # one generator fails twice and is tried again, one fails for good and is left out
    real = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").where("c_acctbal >= 0")
    path = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    made = gate.run_generators({"steady": EveryNth(), "late": EveryNth(2), "broken": EveryNth(99)}, real, real, 500, schema.infer_schema(real), ["c2 >= 0"], path, settings=gate.Settings(min_batch=500, max_batch=500))
    each = [df.agg(F.lit(k).alias("model"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys")) for k, df in made.items()]
    return each[0].unionByName(each[1])


@query(f"""with c as ({CUSTOMER_SQL}), m as (select median(bal) b from c) select 'mi' as imputation, 'real' as generator, count(*) as n, round(sum(coalesce(bal, b)), 4) as bal, round(sum(nat), 4) as nat, round(sum(mixed / (nat + 1)), 4) as ratio from c, m
union all select 'mi', 'GaussianCopula', greatest(count(*), 500), null, null, null from customer""")
def cv4_whole_run(spark, d):
    # what the run writes: of the real table sums, of the drawn one the number of rows
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    customers(spark, d).selectExpr("k", "bal", "nat", "mixed", "nat + 1 as one").write.parquet(f"{path}/in")
    run_pipeline(spark, Config(f"{path}/in", f"{path}/out", fmt="parquet", imputations=("mi",), generators=("GaussianCopula",), thresholds={"Marginal": 0.5}, wanted=["Marginal", "corr_score"], formulas={"ratio": "2/3"}))
    back = spark.read.parquet(f"{path}/out/datasets")
    real = F.col("generator") == "real"
    return back.groupBy("imputation", "generator").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.when(real, F.col(c))), 4).alias(c) for c in ("bal", "nat", "ratio")])


# two standardised columns with a positive correlation r have the axes (1, 1) and (1, -1), with shares (1 + r) / 2 and (1 - r) / 2
@query(f"""with p as ({PAIR_SQL}), u as (select side, price::double as a, cost::double as b from p where price is not null and cost is not null),
m as (select avg(a) ma, stddev_samp(a) sa, avg(b) mb, stddev_samp(b) sb, corr(a, b) r from u),
z as (select side, ((a - ma) / sa + (b - mb) / sb) / sqrt(2) as x, ((a - ma) / sa - (b - mb) / sb) / sqrt(2) as y, r from u, m)
select case side when 'real' then 'real' else 'synthetic' end as source, count(*) as n, round(avg(x), 4) as pc1, round(avg(x * x), 4) as square1, round(avg(y * y), 4) as square2, round((1 + max(r)) / 2, 6) as share1, round((1 - max(r)) / 2, 6) as share2 from z group by side""")
def mx18_pca(spark, d):
    from tabsynth import detect

    real, syn = pair(spark, d)
    out, shares = detect.pca_projection(real, syn, {"price": "numerical", "cost": "numerical"})
    x, y = F.col("pc1"), F.col("pc2")
    found = out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("pc1"), F.round(F.avg(x * x), 4).alias("square1"), F.round(F.avg(y * y), 4).alias("square2"))
    return found.withColumns({"share1": F.round(F.lit(shares[0]), 6), "share2": F.round(F.lit(shares[1]), 6)})


def _small(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select("k", "bal", "seg", "nat", "mixed")


@query()
def cv1_augmented_classification(spark, d):
    path = f"{shared_dir(spark)}/folds-{uuid.uuid4().hex}"
    return augmented_classification_cv(_small(spark, d), "seg", CUSTOMER_META | {"k": "primary_key"}, "k", generator=synth.copula_generator(CUSTOMER_META), generator_name="GaussianCopula", path=path)[1]


@query()
def cv2_augmented_regression(spark, d):
    path = f"{shared_dir(spark)}/folds-{uuid.uuid4().hex}"
    return augmented_regression_cv(_small(spark, d), "bal", CUSTOMER_META | {"k": "primary_key"}, "k", generator=synth.copula_generator(CUSTOMER_META), generator_name="GaussianCopula", path=path)[1]


@query()
def cv3_regression(spark, d):
    return regression_cv(_small(spark, d), "bal", "k")[0]
