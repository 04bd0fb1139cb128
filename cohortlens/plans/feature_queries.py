"""Column-feature, imputation, tile and rank queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions.scalars import month_index, null_safe_sum, safe_ratio
from cohortlens.functions.sql import register_sql_functions
from cohortlens.operators import features as X
from cohortlens.operators import impute as I
from cohortlens.operators import panel as P
from cohortlens.operators import ranks as R
from cohortlens.operators.evaluate import drop_features as drop_listed
from cohortlens.plans.analogs import (
    ID,
    LABEL,
    LABELLED,
    PANEL,
    PERIOD,
    TRAIN,
    labelled,
    panel,
    stored_panel,
    table,
    with_,
)
from cohortlens.plans.registry import ORACLES, query
from cohortlens.operators.ordering import small_buckets
from cohortlens.operators.drift import column_profile
from cohortlens.session import scratch_path, stored
from cohortlens.sources import tables as T
from cohortlens.sources.rules import read_imputation, read_rank_flags, sentinel_rules

# every line's key columns and amounts; the last three carry nulls
_LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS qty, l_extendedprice AS price,
         nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS kept
  FROM lineitem
)"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("kept"),
    )


_KEYS = "l_orderkey, l_linenumber, l_partkey"


@query(
    "null_safe_sum",
    with_(_LINES, f"SELECT {_KEYS}, price, coalesce(kept, 0) + coalesce(price, 0) AS total FROM lines"),
)
def null_safe_sum_query(spark, sf):
    rows = _lines(spark, sf)
    return rows.select(*_KEYS.split(", "), "price", null_safe_sum("kept", "price").alias("total"))


@query(
    "safe_ratio",
    with_(
        _LINES,
        f"""SELECT {_KEYS}, price,
                   coalesce(kept, 0) / nullif(tax, 0) AS ratio,
                   coalesce(qty, 0) / nullif(l_linenumber - 1, 0) AS per_line
            FROM lines""",
    ),
)
def safe_ratio_query(spark, sf):
    rows = _lines(spark, sf)
    return rows.select(
        *_KEYS.split(", "),
        "price",
        safe_ratio("kept", "tax").alias("ratio"),
        safe_ratio(F.col("qty"), F.col("l_linenumber") - 1).alias("per_line"),
    )


@query(
    "row_totals",
    with_(
        _LINES,
        f"""SELECT {_KEYS}, price,
                   coalesce(kept, 0) + coalesce(price, 0) AS m_total,
                   coalesce(discount, 0) + coalesce(tax, 0) + coalesce(qty, 0) AS rates_total,
                   (coalesce(kept, 0) + coalesce(price, 0))
                     + (coalesce(discount, 0) + coalesce(tax, 0) + coalesce(qty, 0)) AS grand_total
            FROM lines""",
    ),
)
def row_totals(spark, sf):
    totals = {
        "m_total": ["kept", "price"],
        "rates_total": ["discount", "tax", "qty"],
        "grand_total": ["m_total", "rates_total"],
    }
    out = X.add_totals(_lines(spark, sf), totals)
    return out.select(*_KEYS.split(", "), "price", *totals)


@query(
    "rowwise_extremes",
    with_(
        _LINES,
        f"""SELECT {_KEYS}, price, greatest(discount, tax) AS rate_high, least(discount, tax) AS rate_low
            FROM lines""",
    ),
)
def rowwise_extremes(spark, sf):
    out = X.add_extremes(_lines(spark, sf), {("rate_high", "rate_low"): ["discount", "tax"]})
    return out.select(*_KEYS.split(", "), "price", "rate_high", "rate_low")


_RATIOS = {
    "m_promedio_spend": ("spend", "n_orders"),
    "m_promedio_filled": ("spend", "n_filled"),
    "m_promedio_urgent": ("top_price", "n_urgent"),
    "proporcion_top": ("top_price", "spend"),
    "proporcion_urgent": ("n_urgent", "n_orders"),
}


@query(
    "ratio_features",
    with_(
        PANEL,
        "SELECT cust, period, "
        + ", ".join(
            f"CAST(coalesce({n}, 0) AS DOUBLE) / nullif({d}, 0) AS {o}"
            for o, (n, d) in _RATIOS.items()
        )
        + " FROM panel",
    ),
)
def ratio_features(spark, sf):
    return X.add_ratios(panel(spark, sf), _RATIOS).select(ID, PERIOD, *_RATIOS)


@query(
    "sql_functions",
    with_(
        _LINES,
        f"""SELECT {_KEYS}, price, coalesce(kept, 0) + coalesce(price, 0) AS total,
                   coalesce(kept, 0) / nullif(tax, 0) AS ratio
            FROM lines""",
    ),
)
def sql_functions(spark, sf):
    register_sql_functions(spark)
    _lines(spark, sf).createOrReplaceTempView("cohortlens_lines")
    return spark.sql(
        f"""SELECT {_KEYS}, price, suma_sin_null(kept, price) AS total,
                   division_segura(kept, tax) AS ratio
            FROM cohortlens_lines"""
    )


# tenure of a customer in a month: months since the customer's first order, from 1
_TENURE = (
    PANEL
    + """,
tenure AS (
  SELECT *, CAST((period // 100 * 12 + period % 100)
            - min(period // 100 * 12 + period % 100) OVER (PARTITION BY cust) + 1 AS INTEGER) AS tenure
  FROM panel
)"""
)


def _with_tenure(spark, sf):
    first = F.min(month_index(PERIOD)).over(Window.partitionBy(ID))
    return panel(spark, sf).withColumn("tenure", month_index(PERIOD) - first + 1)


@query(
    "tenure_scaled_counter",
    with_(
        _TENURE,
        """SELECT cust, period, tenure,
                  CAST(CASE WHEN tenure = 1 THEN n_orders * 3 WHEN tenure = 2 THEN n_orders * 3 / 2
                            ELSE n_orders END AS DOUBLE) AS n_orders
           FROM tenure""",
    ),
)
def tenure_scaled_counter(spark, sf):
    rows = _with_tenure(spark, sf).select(ID, PERIOD, "tenure", "n_orders")
    return X.scale_new_customers(rows, "n_orders", "tenure")


@query(
    "class_targets",
    with_(
        LABELLED,
        """SELECT cust, period, label,
                  CASE label WHEN 'BAJA+2' THEN CAST(1.00002 AS DOUBLE)
                             WHEN 'BAJA+1' THEN CAST(1.00001 AS DOUBLE)
                             ELSE CAST(1 AS DOUBLE) END AS clase_peso,
                  CASE WHEN label = 'BAJA+2' THEN 1 ELSE 0 END AS clase_binaria1,
                  CASE WHEN label = 'CONTINUA' THEN 0 ELSE 1 END AS clase_binaria2
           FROM labelled""",
    ),
)
def class_targets(spark, sf):
    return X.class_targets(labelled(spark, sf).select(ID, PERIOD, LABEL), LABEL)


@query(
    "impute_rules",
    with_(
        PANEL,
        """SELECT cust, period, spend, coalesce(n_filled, -1) AS n_filled,
                  coalesce(n_urgent, 0) AS n_urgent,
                  coalesce(lag(spend, 1) OVER w, -9999999999) AS lag1_spend,
                  coalesce(lag(n_urgent, 2) OVER w, 0) AS lag2_n_urgent
           FROM panel WINDOW w AS (PARTITION BY cust ORDER BY period)""",
    ),
)
def impute_rules(spark, sf):
    rows = panel(spark, sf)
    lags = P.lag_features(rows, ["spend", "n_urgent"], ID, PERIOD, keep=["spend", "n_filled", "n_urgent"])
    rows = lags.select(ID, PERIOD, "spend", "n_filled", "n_urgent", "lag1_spend", "lag2_n_urgent")
    rules = {"spend": None, "n_filled": -1, "n_urgent": 0, "lag1_spend": -9999999999}
    return I.impute_rules(rows, rules)


@query(
    "impute_mean",
    with_(
        PANEL,
        f"""SELECT cust, period,
                   round(coalesce(CAST(n_filled AS DOUBLE), (SELECT avg(n_filled) FROM panel
                     WHERE period IN ({", ".join(map(str, TRAIN))}))), 9) AS n_filled,
                   round(coalesce(CAST(n_urgent AS DOUBLE), (SELECT avg(n_urgent) FROM panel
                     WHERE period IN ({", ".join(map(str, TRAIN))}))), 9) AS n_urgent
            FROM panel""",
    ),
)
def impute_mean(spark, sf):
    cols = ["n_filled", "n_urgent"]
    rows = panel(spark, sf).select(ID, PERIOD, *[F.col(c).cast("double").alias(c) for c in cols])
    means = I.column_means(P.months_in(rows, PERIOD, TRAIN), cols)
    out = I.impute_mean(rows, means)
    return out.withColumns({c: F.round(c, 9) for c in cols})


@query(
    "drop_features",
    with_(PANEL, "SELECT cust, period, n_orders, spend, n_filled FROM panel"),
)
def drop_features(spark, sf):
    rows = panel(spark, sf)
    # measures that are never missing stay; columns of small parts are listed by name
    listed = table(spark, sf, "part").select(
        F.when(F.col("p_size") % 2 == 0, F.lit("top_price"))
        .when(F.col("p_size") % 3 == 0, F.lit("n_urgent"))
        .otherwise(F.concat(F.lit("lag1_"), "p_name"))
        .alias("fname")
    )
    return drop_listed(rows, listed)


@query(
    "tenure_decile",
    with_(
        _TENURE,
        """SELECT cust, period, tenure,
                  ntile(10) OVER (PARTITION BY period ORDER BY tenure ASC NULLS LAST, cust)
                    AS tenure_decil
           FROM tenure""",
    ),
)
def tenure_decile(spark, sf):
    rows = stored(_with_tenure(spark, sf).select(ID, PERIOD, "tenure"), "tenure")
    out = R.ntile_features(rows, ["tenure"], ID, PERIOD, tiles=10, prefix="d_", replace=False)
    return out.withColumnRenamed("d_tenure", "tenure_decil")


@query(
    "ntile_features",
    with_(
        PANEL,
        "SELECT cust, period, n_orders, "
        + ", ".join(
            f"ntile(200) OVER (PARTITION BY period ORDER BY {c} ASC NULLS LAST, cust) AS ntile_{c}"
            for c in ("spend", "top_price", "n_filled", "n_urgent")
        )
        + " FROM panel",
    ),
)
def ntile_features(spark, sf):
    cols = ["spend", "top_price", "n_filled", "n_urgent"]
    return R.ntile_features(stored_panel(spark, sf), cols, ID, PERIOD, tiles=200)


_FLAGS = {
    "spend": {"ordinal", "percentil", "decil", "cuartil"},
    "n_urgent": {"ordinal", "decil", "cuartil"},
    "n_orders": {"ordinal"},
    "top_price": {"ordinal", "cuartil"},
}


def _rank_sql(member: str, c: str) -> str:
    by_value = f"(PARTITION BY period ORDER BY {c} ASC NULLS LAST)"
    by_row = f"(PARTITION BY period ORDER BY {c} ASC NULLS LAST, cust)"
    call = {
        "ordinal": f"rank() OVER {by_value}",
        "percentil": f"percent_rank() OVER {by_value}",
        "decil": f"ntile(10) OVER {by_row}",
        "cuartil": f"ntile(4) OVER {by_row}",
    }[member]
    return f"CAST({call} AS DOUBLE) AS {member}_{c}"


@query(
    "rank_family",
    with_(
        PANEL,
        "SELECT cust, period, "
        + ", ".join(_rank_sql(m, c) for c in _FLAGS for m in R.RANKS if m in _FLAGS[c])
        + " FROM panel",
    ),
)
def rank_family(spark, sf):
    return R.rank_family(stored_panel(spark, sf), _FLAGS, ID, PERIOD)


@query("ntile_features_buckets", ORACLES["ntile_features"])
def ntile_features_buckets(spark, sf):
    with small_buckets():
        return ntile_features(spark, sf)


@query("rank_family_buckets", ORACLES["rank_family"])
def rank_family_buckets(spark, sf):
    with small_buckets():
        return rank_family(spark, sf)


@query("tenure_decile_buckets", ORACLES["tenure_decile"])
def tenure_decile_buckets(spark, sf):
    with small_buckets():
        return tenure_decile(spark, sf)


_PANEL_TEXT = PANEL + """,
text_panel AS (SELECT printf('customer-%012d', cust) AS cust, period, spend, n_orders, n_urgent, top_price FROM panel)"""


@query(
    "rank_family_text_id",
    with_(
        _PANEL_TEXT,
        "SELECT cust, period, "
        + ", ".join(_rank_sql(m, c) for c in _FLAGS for m in R.RANKS if m in _FLAGS[c])
        + " FROM text_panel",
    ),
)
def rank_family_text_id(spark, sf):
    rows = stored_panel(spark, sf).withColumn(ID, F.format_string("customer-%012d", ID))
    return R.rank_family(rows, _FLAGS, ID, PERIOD)


# a hundred amount columns: bands of the two amounts, shifted and scaled
_WIDE = [(f"m{i}", "spend" if i % 2 else "top_price", 97 * (i + 1)) for i in range(100)]


@query(
    "ntile_features_wide",
    with_(
        PANEL
        + ", wide AS (SELECT cust, period, "
        + ", ".join(f"CAST(CAST(floor({c}) AS BIGINT) % {k} AS DOUBLE) AS {n}" for n, c, k in _WIDE)
        + " FROM panel)",
        "SELECT cust, period, "
        + ", ".join(
            f"ntile(200) OVER (PARTITION BY period ORDER BY {n} ASC NULLS LAST, cust) AS ntile_{n}" for n, _, _ in _WIDE
        )
        + " FROM wide",
    ),
)
def ntile_features_wide(spark, sf):
    made = [(F.floor(c).cast("long") % k).cast("double").alias(n) for n, c, k in _WIDE]
    # The amounts are stored, the hundred columns are made from them in every pass: that is cheaper than to read them.
    rows = stored(panel(spark, sf).select(ID, PERIOD, "spend", "top_price").sortWithinPartitions(PERIOD), "amounts")
    return R.ntile_features(rows.select(ID, PERIOD, *made), [n for n, _, _ in _WIDE], ID, PERIOD, tiles=200)


@query(
    "impute_rules_whole_numbers",
    with_(
        PANEL,
        """SELECT cust, period, coalesce(CAST(n_filled AS BIGINT), -9999999999) AS n_filled,
                  coalesce(CAST(n_urgent AS DOUBLE), -0.5) AS n_urgent, n_orders FROM panel""",
    ),
)
def impute_rules_whole_numbers(spark, sf):
    rows = panel(spark, sf).select(ID, PERIOD, "n_filled", "n_urgent", "n_orders")
    return I.impute_rules(rows, {"n_filled": -9999999999.0, "n_urgent": -0.5, "n_orders": -1.0})


# rules for the columns of the panel, written as the three rule files and read back
_RULE_SQL = PANEL + """,
facts AS (
  SELECT """ + ", ".join(f"max({c}) AS {c}" for c in ("n_filled", "n_urgent")) + """ FROM panel
)"""


@query(
    "rule_files",
    with_(
        _RULE_SQL,
        """SELECT cust, period, coalesce(n_filled, -(SELECT n_filled FROM facts)) AS n_filled,
                  coalesce(n_urgent, -(SELECT n_urgent FROM facts)) AS n_urgent,
                  CAST(rank() OVER (PARTITION BY period ORDER BY spend ASC NULLS LAST) AS DOUBLE) AS ordinal_spend
           FROM panel""",
    ),
)
def rule_files(spark, sf):
    rows = stored_panel(spark, sf)
    counts = ["n_filled", "n_urgent"]
    highest = rows.agg(*[F.max(c).alias(c) for c in counts]).unpivot([], counts, "var", "top")
    sentinels = highest.select(
        F.col("var").alias("varname"), F.col("var").alias("varcname"), (-F.col("top")).cast("string").alias("CASO_NULL")
    )
    path = scratch_path(spark, "imputation")
    T.write_csv(sentinels.coalesce(1), path)
    profile = column_profile(rows, ["spend", *counts])
    flags = profile.select(
        F.col("feature").alias("var"), "min", "max", "nunique", "nulls", F.lit("a, b").alias("DESCRIPCION"),
        F.when(F.col("feature") == "spend", "T").otherwise("F").alias("ordinal"),
        *[F.lit("F").alias(m) for m in ("percentil", "decil", "cuartil")],
    )
    flag_path = scratch_path(spark, "flags")
    T.write_csv(flags.coalesce(1), flag_path)
    filled = I.impute_rules(rows.select(ID, PERIOD, *counts), sentinel_rules(read_imputation(spark, path)))
    return filled.join(R.rank_family(rows, read_rank_flags(spark, flag_path), ID, PERIOD), [ID, PERIOD])


# a bank snapshot: every column that the name tables use is one of four measures of the panel
_MADE = [*X.TOTALS, *[n for pair in X.EXTREMES for n in pair], *X.RATIOS]
_USED = [p for parts in [*X.TOTALS.values(), *X.EXTREMES.values(), *X.RATIOS.values()] for p in parts]
_GIVEN = sorted(set(_USED) - set(_MADE) - {"ctrx_quarter", "cliente_antiguedad"})
_SOURCE = ["spend", "top_price", "n_filled", "n_urgent"]


# The derived columns by their formulas, stated apart from the name tables of the code.
_BANK_COLUMNS = """
         coalesce(Master_mlimitecompra, 0) + coalesce(Visa_mlimitecompra, 0) AS mtotal_limitecompra,
         coalesce(Visa_mfinanciacion_limite, 0) + coalesce(Master_mfinanciacion_limite, 0) AS mtotal_financiacion_limite,
         coalesce(Master_msaldototal, 0) + coalesce(Visa_msaldototal, 0) AS mtotal_saldototal,
         coalesce(mcuentas_saldo, 0) + coalesce(minversion1_pesos, 0) + coalesce(minversion2, 0)
           + coalesce(mplazo_fijo_dolares, 0) + coalesce(mplazo_fijo_pesos, 0) AS mtotal_patrimonio,
         coalesce(mprestamos_personales, 0) + coalesce(mprestamos_prendarios, 0)
           + coalesce(mprestamos_hipotecarios, 0) AS mtotal_prestamos,
         coalesce(mtarjeta_visa_consumo, 0) + coalesce(mtarjeta_master_consumo, 0) AS mtc_consumo_total,
         coalesce(mttarjeta_visa_debitos_automaticos, 0) + coalesce(mttarjeta_master_debitos_automaticos, 0) AS mtc_debitosautomaticos_total,
         coalesce(Master_mfinanciacion_limite, 0) + coalesce(Visa_mfinanciacion_limite, 0) AS mtc_financiacionlimite_total,
         coalesce(Master_msaldopesos, 0) + coalesce(Visa_msaldopesos, 0) AS mtc_saldopesos_total,
         coalesce(Master_msaldodolares, 0) + coalesce(Visa_msaldodolares, 0) AS mtc_saldodolares_total,
         coalesce(Master_mconsumospesos, 0) + coalesce(Visa_mconsumospesos, 0) AS mtc_consumopesos_total,
         coalesce(Master_mconsumosdolares, 0) + coalesce(Visa_mconsumosdolares, 0) AS mtc_consumodolares_total,
         coalesce(Master_mlimitecompra, 0) + coalesce(Visa_mlimitecompra, 0) AS mtc_limitecompra_total,
         coalesce(Master_madelantopesos, 0) + coalesce(Visa_madelantopesos, 0) AS mtc_adelantopesos_total,
         coalesce(Master_madelantodolares, 0) + coalesce(Visa_madelantodolares, 0) AS mtc_adelantodolares_total,
         coalesce(mtc_adelantopesos_total, 0) + coalesce(mtc_adelantodolares_total, 0) AS mtc_adelanto_total,
         coalesce(Master_mpagado, 0) + coalesce(Visa_mpagado, 0) AS mtc_pagado_total,
         coalesce(Master_mpagospesos, 0) + coalesce(Visa_mpagospesos, 0) AS mtc_pagadopesos_total,
         coalesce(Master_mpagosdolares, 0) + coalesce(Visa_mpagosdolares, 0) AS mtc_pagadodolares_total,
         coalesce(Master_msaldototal, 0) + coalesce(Visa_msaldototal, 0) AS mtc_saldototal_total,
         coalesce(Master_mconsumototal, 0) + coalesce(Visa_mconsumototal, 0) AS mtc_consumototal_total,
         coalesce(Master_cconsumos, 0) + coalesce(Visa_cconsumos, 0) AS tc_cconsumos_total,
         coalesce(Master_delinquency, 0) + coalesce(Visa_delinquency, 0) AS tc_morosidad_total,
         coalesce(mplazo_fijo_dolares, 0) + coalesce(mplazo_fijo_pesos, 0) AS m_plazofijo_total,
         coalesce(minversion1_dolares, 0) + coalesce(minversion1_pesos, 0) AS m_inversion1_total,
         coalesce(mpayroll, 0) + coalesce(mpayroll2, 0) AS m_payroll_total,
         coalesce(cpayroll_trx, 0) + coalesce(cpayroll2_trx, 0) AS c_payroll_total,
         coalesce(cseguro_vida, 0) + coalesce(cseguro_auto, 0) + coalesce(cseguro_vivienda, 0) + coalesce(cseguro_accidentes_personales, 0) AS c_seguros_total,
         greatest(Master_Fvencimiento, Visa_Fvencimiento) AS tc_fvencimiento_mayor,
         least(Master_Fvencimiento, Visa_Fvencimiento) AS tc_fvencimiento_menor,
         greatest(Master_fechaalta, Visa_fechaalta) AS tc_fechaalta_mayor,
         least(Master_fechaalta, Visa_fechaalta) AS tc_fechalta_menor,
         greatest(Master_Finiciomora, Visa_Finiciomora) AS tc_fechamora_mayor,
         least(Master_Finiciomora, Visa_Finiciomora) AS tc_fechamora_menor,
         greatest(Master_fultimo_cierre, Visa_fultimo_cierre) AS tc_fechacierre_mayor,
         least(Master_fultimo_cierre, Visa_fultimo_cierre) AS tc_fechacierre_menor,
         coalesce(m_plazofijo_total, 0) / nullif(cplazo_fijo, 0) AS m_promedio_plazofijo_total,
         coalesce(m_inversion1_total, 0) / nullif(cinversion1, 0) AS m_promedio_inversion_total,
         coalesce(mcaja_ahorro, 0) / nullif(ccaja_ahorro, 0) AS m_promedio_caja_ahorro,
         coalesce(mtarjeta_visa_consumo, 0) / nullif(ctarjeta_visa_transacciones, 0) AS m_promedio_tarjeta_visa_consumo_por_transaccion,
         coalesce(mtarjeta_master_consumo, 0) / nullif(ctarjeta_master_transacciones, 0) AS m_promedio_tarjeta_master_consumo_por_transaccion,
         coalesce(mprestamos_personales, 0) / nullif(cprestamos_personales, 0) AS m_promedio_prestamos_personales,
         coalesce(mprestamos_prendarios, 0) / nullif(cprestamos_prendarios, 0) AS m_promedio_prestamos_prendarios,
         coalesce(mprestamos_hipotecarios, 0) / nullif(cprestamos_hipotecarios, 0) AS m_promedio_prestamos_hipotecarios,
         coalesce(minversion2, 0) / nullif(cinversion2, 0) AS m_promedio_inversion2,
         coalesce(mpagodeservicios, 0) / nullif(cpagodeservicios, 0) AS m_promedio_pagodeservicios,
         coalesce(mpagomiscuentas, 0) / nullif(cpagomiscuentas, 0) AS m_promedio_pagomiscuentas,
         coalesce(mcajeros_propios_descuentos, 0) / nullif(ccajeros_propios_descuentos, 0) AS m_promedio_cajeros_propios_descuentos,
         coalesce(mtarjeta_visa_descuentos, 0) / nullif(ctarjeta_visa_descuentos, 0) AS m_promedio_tarjeta_visa_descuentos,
         coalesce(mtarjeta_master_descuentos, 0) / nullif(ctarjeta_master_descuentos, 0) AS m_promedio_tarjeta_master_descuentos,
         coalesce(mcomisiones_mantenimiento, 0) / nullif(ccomisiones_mantenimiento, 0) AS m_promedio_comisiones_mantenimiento,
         coalesce(mcomisiones_otras, 0) / nullif(ccomisiones_otras, 0) AS m_promedio_comisiones_otras,
         coalesce(mforex_buy, 0) / nullif(cforex_buy, 0) AS m_promedio_forex_buy,
         coalesce(mforex_sell, 0) / nullif(cforex_sell, 0) AS m_promedio_forex_sell,
         coalesce(mtransferencias_recibidas, 0) / nullif(ctransferencias_recibidas, 0) AS m_promedio_transferencias_recibidas,
         coalesce(mtransferencias_emitidas, 0) / nullif(ctransferencias_emitidas, 0) AS m_promedio_transferencias_emitidas,
         coalesce(mextraccion_autoservicio, 0) / nullif(cextraccion_autoservicio, 0) AS m_promedio_extraccion_autoservicio,
         coalesce(mcheques_depositados, 0) / nullif(ccheques_depositados, 0) AS m_promedio_cheques_depositados,
         coalesce(mcheques_emitidos, 0) / nullif(ccheques_emitidos, 0) AS m_promedio_cheques_emitidos,
         coalesce(mcheques_depositados_rechazados, 0) / nullif(ccheques_depositados_rechazados, 0) AS m_promedio_cheques_depositados_rechazados,
         coalesce(mcheques_emitidos_rechazados, 0) / nullif(ccheques_emitidos_rechazados, 0) AS m_promedio_cheques_emitidos_rechazados,
         coalesce(matm, 0) / nullif(catm_trx, 0) AS m_promedio_atm,
         coalesce(matm_other, 0) / nullif(catm_trx_other, 0) AS m_promedio_atm_other,
         coalesce(Master_msaldototal, 0) / nullif(Master_mfinanciacion_limite, 0) AS proporcion_financiacion_master_cubierto,
         coalesce(Master_msaldototal, 0) / nullif(Master_mlimitecompra, 0) AS proporcion_limite_master_cubierto,
         coalesce(Visa_msaldototal, 0) / nullif(Visa_mfinanciacion_limite, 0) AS proporcion_financiacion_visa_cubierto,
         coalesce(Visa_msaldototal, 0) / nullif(Visa_mlimitecompra, 0) AS proporcion_limite_visa_cubierto,
         coalesce(mtc_saldototal_total, 0) / nullif(mtc_financiacionlimite_total, 0) AS proporcion_financiacion_total_cubierto,
         coalesce(mtc_saldototal_total, 0) / nullif(mtc_limitecompra_total, 0) AS proporcion_limite_total_cubierto,
         coalesce(mtc_saldopesos_total, 0) / nullif(mtc_saldototal_total, 0) AS tc_proporcion_saldo_pesos,
         coalesce(mtc_saldodolares_total, 0) / nullif(mtc_saldototal_total, 0) AS tc_proporcion_saldo_dolares,
         coalesce(mtc_consumopesos_total, 0) / nullif(mtc_consumototal_total, 0) AS tc_proporcion_consumo_pesos,
         coalesce(mtc_consumodolares_total, 0) / nullif(mtc_consumototal_total, 0) AS tc_proporcion_consumo_dolares,
         coalesce(mtc_consumototal_total, 0) / nullif(mtc_limitecompra_total, 0) AS tc_proporcion_consumo_total_limite_total_cubierto,
         coalesce(mtc_pagadopesos_total, 0) / nullif(mtc_pagado_total, 0) AS tc_proporcion_pago_pesos,
         coalesce(mtc_pagadodolares_total, 0) / nullif(mtc_pagado_total, 0) AS tc_proporcion_pago_dolares,
         coalesce(mtc_adelantopesos_total, 0) / nullif(mtc_adelanto_total, 0) AS tc_proporcion_adelanto_pesos,
         coalesce(mtc_adelantodolares_total, 0) / nullif(mtc_adelanto_total, 0) AS tc_proporcion_adelanto_dolares
"""


def _bank_sql() -> str:
    """Given columns and the formulas; later columns use earlier ones by their names."""
    given = ", ".join(f"CAST({_SOURCE[i % 4]} AS DOUBLE) + {i} AS {n}" for i, n in enumerate(_GIVEN))
    return (
        PANEL
        + f""", given AS (
  SELECT cust, period, n_filled AS cliente_antiguedad,
         CASE WHEN n_filled = 1 THEN CAST(n_orders AS DOUBLE) * 3
              WHEN n_filled = 2 THEN CAST(n_orders AS DOUBLE) * 3 / 2
              ELSE CAST(n_orders AS DOUBLE) END AS ctrx_quarter, {given} FROM panel
), made AS (SELECT cust, period, ctrx_quarter, {_BANK_COLUMNS} FROM given)"""
    )


@query(
    "bank_features",
    with_(_bank_sql(), "SELECT * FROM made"),
)
def bank_features(spark, sf):
    given = [(F.col(_SOURCE[i % 4]).cast("double") + i).alias(n) for i, n in enumerate(_GIVEN)]
    rows = panel(spark, sf).select(
        ID, PERIOD, F.col("n_filled").alias("cliente_antiguedad"), F.col("n_orders").alias("ctrx_quarter"), *given
    )
    out = X.bank_features(rows)
    return out.select(ID, PERIOD, "ctrx_quarter", *_MADE)
