"""A fact-shaped view over the star tables: one row per line item.

The expressions are plain SQL that Spark and DuckDB read alike. Only the tables
that the asked columns need are joined; they are left joins on unique keys, so
leaving one out never changes the rows.

Orders get what hangs on them (customer, nation, region) before they meet the line items:
left joins on equal keys may be done in either order, also where keys are null or come
twice, and so the line items are shuffled once for the part and once for the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "%E%"
REAL_YEARS = tuple(range(1995, 2002))
PROJECTED_YEARS = (2004, 2007)

# column -> (expression, tables beyond lineitem)
COLUMNS = {
    "l_orderkey": ("l_orderkey", ""),
    "l_linenumber": ("l_linenumber", ""),
    "l_partkey": ("l_partkey", ""),
    "l_suppkey": ("l_suppkey", ""),
    "nu_ano": ("cast(year(o_orderdate) as int)", "o"),
    "co_grupo": (
        "cast(case p_type when 'ECONOMY' then 72 when 'STANDARD' then 79 when 'LARGE' then 4003"
        " when 'MEDIUM' then 4004 when 'PROMO' then 4005 else 4006 end as bigint)",
        "p",
    ),
    "curso_nome": ("p_type", "p"),
    "tipo_ensino": (
        "case when p_type in ('ECONOMY', 'STANDARD') then 'Tecnologia'"
        " when p_type = 'PROMO' then 'Licenciatura' else 'Bacharelado' end",
        "p",
    ),
    "co_regiao": ("cast(r_regionkey as int)", "ocnr"),
    "regiao_nome": ("r_name", "ocnr"),
    "co_uf": ("cast(n_nationkey as bigint)", "ocn"),
    "uf_sigla": ("nullif(replace(n_name, 'NATION_', 'U'), 'U7')", "ocn"),
    "uf_nome": ("n_name", "ocn"),
    "co_municipio": ("o_custkey", "o"),
    "co_categad": ("cast(substr(o_orderpriority, 1, 1) as int)", "o"),
    "tipo_ies": ("nullif(o_orderpriority, '4-NOT SPECIFIED')", "o"),
    "modalidade": ("nullif(l_linestatus, 'O')", ""),
    "nt_ger": ("case when l_quantity <> 13 then round(l_extendedprice / 1050, 3) end", ""),
    "nt_fg": ("l_quantity * 2", ""),
    "nt_ce": ("cast(p_size * 2 as double)", "p"),
    "faixa_nota": (
        "case when l_quantity = 13 then null when l_extendedprice / 1050 <= 33 then 'baixo'"
        " when l_extendedprice / 1050 <= 66 then 'medio' else 'alto' end",
        "",
    ),
    "faixa_prevista": (
        "case when l_linenumber = 7 then null when l_quantity * 2 <= 33 then 'baixo'"
        " when l_quantity * 2 <= 66 then 'medio' else 'alto' end",
        "",
    ),
    "qe_renda": (
        "case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1"
        " when 'FURNITURE' then 2 when 'HOUSEHOLD' then 3 end",
        "oc",
    ),
    "renda_nome": (
        "case c_mktsegment when 'AUTOMOBILE' then 'Até 1,5 SM' when 'BUILDING' then '1,5 a 3 SM'"
        " when 'FURNITURE' then '3 a 4,5 SM' when 'HOUSEHOLD' then '4,5 a 6 SM' end",
        "oc",
    ),
    "qe_raca_cor": ("cast(l_suppkey % 7 as int)", ""),
    "qe_estado_civil": ("nullif(substr('ABCDE', cast(1 + l_partkey % 5 as int), 1), 'C')", ""),
    "sexo": ("nullif(o_orderstatus, 'P')", "o"),
    "qe_escola_em": ("nullif(cast(p_size % 6 as int), 5)", "p"),
    "escola_em_nome": (
        "case p_size % 6 when 0 then 'Todo em escola pública'"
        " when 1 then 'Maior parte em escola pública' when 2 then 'Metade em escola pública'"
        " when 3 then 'Maior parte em escola privada' when 4 then 'Todo em escola privada' end",
        "p",
    ),
    "qe_financiamento": ("nullif(cast(l_partkey % 7 as int), 6)", ""),
    "qe_horas_estudo": ("l_linenumber % 4", ""),
    "qe_trabalha": ("cast(l_quantity as int) % 5", ""),
    "qe_horas_trabalho": ("cast(round(l_tax * 100) as int) % 4", ""),
    "qe_uso_biblioteca": ("case l_returnflag when 'A' then 'A' when 'N' then 'B' end", ""),
    "qe_acesso_internet": ("substr('ABCDE', 1 + cast(round(l_discount * 100) as int) % 5, 1)", ""),
    "cluster_id": ("nullif(l_linenumber % 5, 4)", ""),
    "pca_x": ("l_discount * 12.3456789e0 - 0.5e0", ""),
    "pca_y": ("l_tax * 7.7777777e0", ""),
}
JOINS = (
    ("o", "orders", "l_orderkey", "o_orderkey"),
    ("c", "customer", "o_custkey", "c_custkey"),
    ("n", "nation", "c_nationkey", "n_nationkey"),
    ("r", "region", "n_regionkey", "r_regionkey"),
    ("p", "part", "l_partkey", "p_partkey"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The view with the asked columns (all when none are named)."""
    names = columns or tuple(COLUMNS)
    needed = set("".join(COLUMNS[c][1] for c in names))
    joined = {"l": table(spark, sf_dir, "lineitem")}
    for short, name, left, right in JOINS:
        other, side = table(spark, sf_dir, name), "l" if short == "p" else "o"
        if short in needed:
            joined[side] = joined[side].join(other, F.col(left) == F.col(right), "left") if side in joined else other
    rows = joined["l"]
    if "o" in joined:
        rows = rows.join(joined["o"], F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select(*[F.expr(COLUMNS[c][0]).alias(c) for c in names])


def fact_sql() -> str:
    select = ", ".join(f"{e} AS {c}" for c, (e, _) in COLUMNS.items())
    joins = " ".join(f"LEFT JOIN {t} ON {a} = {b}" for _, t, a, b in JOINS)
    return f"fact AS (SELECT {select} FROM lineitem {joins})"
