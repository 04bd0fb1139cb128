"""Derived columns of the bank snapshot, from plain name tables.

The functions take any such tables, so other data sets bring their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import (
    binary_targets,
    class_weight,
    null_safe_sum,
    safe_ratio,
    tenure_scaled,
)
from cohortlens.operators.ranks import ntile_features

# Derived column = null-safe sum of columns.
TOTALS = {
    "mtotal_limitecompra": ["Master_mlimitecompra", "Visa_mlimitecompra"],
    "mtotal_financiacion_limite": ["Visa_mfinanciacion_limite", "Master_mfinanciacion_limite"],
    "mtotal_saldototal": ["Master_msaldototal", "Visa_msaldototal"],
    "mtotal_patrimonio": [
        "mcuentas_saldo",
        "minversion1_pesos",
        "minversion2",
        "mplazo_fijo_dolares",
        "mplazo_fijo_pesos",
    ],
    "mtotal_prestamos": [
        "mprestamos_personales",
        "mprestamos_prendarios",
        "mprestamos_hipotecarios",
    ],
    "mtc_consumo_total": ["mtarjeta_visa_consumo", "mtarjeta_master_consumo"],
    "mtc_debitosautomaticos_total": [
        "mttarjeta_visa_debitos_automaticos",
        "mttarjeta_master_debitos_automaticos",
    ],
    "mtc_financiacionlimite_total": ["Master_mfinanciacion_limite", "Visa_mfinanciacion_limite"],
    "mtc_saldopesos_total": ["Master_msaldopesos", "Visa_msaldopesos"],
    "mtc_saldodolares_total": ["Master_msaldodolares", "Visa_msaldodolares"],
    "mtc_consumopesos_total": ["Master_mconsumospesos", "Visa_mconsumospesos"],
    "mtc_consumodolares_total": ["Master_mconsumosdolares", "Visa_mconsumosdolares"],
    "mtc_limitecompra_total": ["Master_mlimitecompra", "Visa_mlimitecompra"],
    "mtc_adelantopesos_total": ["Master_madelantopesos", "Visa_madelantopesos"],
    "mtc_adelantodolares_total": ["Master_madelantodolares", "Visa_madelantodolares"],
    "mtc_adelanto_total": ["mtc_adelantopesos_total", "mtc_adelantodolares_total"],
    "mtc_pagado_total": ["Master_mpagado", "Visa_mpagado"],
    "mtc_pagadopesos_total": ["Master_mpagospesos", "Visa_mpagospesos"],
    "mtc_pagadodolares_total": ["Master_mpagosdolares", "Visa_mpagosdolares"],
    "mtc_saldototal_total": ["Master_msaldototal", "Visa_msaldototal"],
    "mtc_consumototal_total": ["Master_mconsumototal", "Visa_mconsumototal"],
    "tc_cconsumos_total": ["Master_cconsumos", "Visa_cconsumos"],
    "tc_morosidad_total": ["Master_delinquency", "Visa_delinquency"],
    "m_plazofijo_total": ["mplazo_fijo_dolares", "mplazo_fijo_pesos"],
    "m_inversion1_total": ["minversion1_dolares", "minversion1_pesos"],
    "m_payroll_total": ["mpayroll", "mpayroll2"],
    "c_payroll_total": ["cpayroll_trx", "cpayroll2_trx"],
    "c_seguros_total": [
        "cseguro_vida",
        "cseguro_auto",
        "cseguro_vivienda",
        "cseguro_accidentes_personales",
    ],
}

# Fixed values: (latest, earliest) column = greatest and least of two card dates.
EXTREMES = {
    ("tc_fvencimiento_mayor", "tc_fvencimiento_menor"): ["Master_Fvencimiento", "Visa_Fvencimiento"],
    ("tc_fechaalta_mayor", "tc_fechalta_menor"): ["Master_fechaalta", "Visa_fechaalta"],
    ("tc_fechamora_mayor", "tc_fechamora_menor"): ["Master_Finiciomora", "Visa_Finiciomora"],
    ("tc_fechacierre_mayor", "tc_fechacierre_menor"): [
        "Master_fultimo_cierre",
        "Visa_fultimo_cierre",
    ],
}

# Derived column = safe ratio of (numerator, denominator).
RATIOS = {
    "m_promedio_plazofijo_total": ("m_plazofijo_total", "cplazo_fijo"),
    "m_promedio_inversion_total": ("m_inversion1_total", "cinversion1"),
    "m_promedio_caja_ahorro": ("mcaja_ahorro", "ccaja_ahorro"),
    "m_promedio_tarjeta_visa_consumo_por_transaccion": (
        "mtarjeta_visa_consumo",
        "ctarjeta_visa_transacciones",
    ),
    "m_promedio_tarjeta_master_consumo_por_transaccion": (
        "mtarjeta_master_consumo",
        "ctarjeta_master_transacciones",
    ),
    "m_promedio_prestamos_personales": ("mprestamos_personales", "cprestamos_personales"),
    "m_promedio_prestamos_prendarios": ("mprestamos_prendarios", "cprestamos_prendarios"),
    "m_promedio_prestamos_hipotecarios": ("mprestamos_hipotecarios", "cprestamos_hipotecarios"),
    "m_promedio_inversion2": ("minversion2", "cinversion2"),
    "m_promedio_pagodeservicios": ("mpagodeservicios", "cpagodeservicios"),
    "m_promedio_pagomiscuentas": ("mpagomiscuentas", "cpagomiscuentas"),
    "m_promedio_cajeros_propios_descuentos": (
        "mcajeros_propios_descuentos",
        "ccajeros_propios_descuentos",
    ),
    "m_promedio_tarjeta_visa_descuentos": ("mtarjeta_visa_descuentos", "ctarjeta_visa_descuentos"),
    "m_promedio_tarjeta_master_descuentos": (
        "mtarjeta_master_descuentos",
        "ctarjeta_master_descuentos",
    ),
    "m_promedio_comisiones_mantenimiento": (
        "mcomisiones_mantenimiento",
        "ccomisiones_mantenimiento",
    ),
    "m_promedio_comisiones_otras": ("mcomisiones_otras", "ccomisiones_otras"),
    "m_promedio_forex_buy": ("mforex_buy", "cforex_buy"),
    "m_promedio_forex_sell": ("mforex_sell", "cforex_sell"),
    "m_promedio_transferencias_recibidas": (
        "mtransferencias_recibidas",
        "ctransferencias_recibidas",
    ),
    "m_promedio_transferencias_emitidas": ("mtransferencias_emitidas", "ctransferencias_emitidas"),
    "m_promedio_extraccion_autoservicio": ("mextraccion_autoservicio", "cextraccion_autoservicio"),
    "m_promedio_cheques_depositados": ("mcheques_depositados", "ccheques_depositados"),
    "m_promedio_cheques_emitidos": ("mcheques_emitidos", "ccheques_emitidos"),
    "m_promedio_cheques_depositados_rechazados": (
        "mcheques_depositados_rechazados",
        "ccheques_depositados_rechazados",
    ),
    "m_promedio_cheques_emitidos_rechazados": (
        "mcheques_emitidos_rechazados",
        "ccheques_emitidos_rechazados",
    ),
    "m_promedio_atm": ("matm", "catm_trx"),
    "m_promedio_atm_other": ("matm_other", "catm_trx_other"),
    "proporcion_financiacion_master_cubierto": (
        "Master_msaldototal",
        "Master_mfinanciacion_limite",
    ),
    "proporcion_limite_master_cubierto": ("Master_msaldototal", "Master_mlimitecompra"),
    "proporcion_financiacion_visa_cubierto": ("Visa_msaldototal", "Visa_mfinanciacion_limite"),
    "proporcion_limite_visa_cubierto": ("Visa_msaldototal", "Visa_mlimitecompra"),
    "proporcion_financiacion_total_cubierto": (
        "mtc_saldototal_total",
        "mtc_financiacionlimite_total",
    ),
    "proporcion_limite_total_cubierto": ("mtc_saldototal_total", "mtc_limitecompra_total"),
    "tc_proporcion_saldo_pesos": ("mtc_saldopesos_total", "mtc_saldototal_total"),
    "tc_proporcion_saldo_dolares": ("mtc_saldodolares_total", "mtc_saldototal_total"),
    "tc_proporcion_consumo_pesos": ("mtc_consumopesos_total", "mtc_consumototal_total"),
    "tc_proporcion_consumo_dolares": ("mtc_consumodolares_total", "mtc_consumototal_total"),
    "tc_proporcion_consumo_total_limite_total_cubierto": (
        "mtc_consumototal_total",
        "mtc_limitecompra_total",
    ),
    "tc_proporcion_pago_pesos": ("mtc_pagadopesos_total", "mtc_pagado_total"),
    "tc_proporcion_pago_dolares": ("mtc_pagadodolares_total", "mtc_pagado_total"),
    "tc_proporcion_adelanto_pesos": ("mtc_adelantopesos_total", "mtc_adelanto_total"),
    "tc_proporcion_adelanto_dolares": ("mtc_adelantodolares_total", "mtc_adelanto_total"),
}

# Decile column = tile of another column inside the month.
DECILES = {
    "cliente_antiguedad_decil": "cliente_antiguedad",
    "antiguedad_tarjetas": "tc_fechaalta_mayor",
}


def add_totals(df: DataFrame, totals: dict[str, list[str]]) -> DataFrame:
    """Null-safe sums; a total may use totals listed before it."""
    pending: dict = {}
    for name, parts in totals.items():
        if any(p in pending for p in parts):
            df, pending = df.withColumns(pending), {}
        pending[name] = null_safe_sum(*parts)
    return df.withColumns(pending)


def add_extremes(df: DataFrame, extremes: dict[tuple[str, str], list[str]]) -> DataFrame:
    """Row-wise greatest and least, nulls skipped."""
    made = {}
    for (high, low), parts in extremes.items():
        made[high], made[low] = F.greatest(*parts), F.least(*parts)
    return df.withColumns(made)


def add_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: safe_ratio(n, d) for name, (n, d) in ratios.items()})


def scale_new_customers(df: DataFrame, counter: str, tenure: str) -> DataFrame:
    """Correct a quarterly counter of customers younger than a quarter; it becomes the last column."""
    others = [c for c in df.columns if c != counter]
    return df.select(*others, tenure_scaled(counter, tenure).alias(counter))


def class_targets(df: DataFrame, label: str) -> DataFrame:
    """Add the class weight and the two binary targets."""
    second, not_staying = binary_targets(label)
    return df.withColumns(
        {
            "clase_peso": class_weight(label),
            "clase_binaria1": second,
            "clase_binaria2": not_staying,
        }
    )


def add_deciles(df: DataFrame, deciles: dict[str, str], id_col: str, period: str) -> DataFrame:
    """Deciles of columns inside each period; ties by id, nulls last."""
    out = ntile_features(
        df, list(deciles.values()), id_col, period, tiles=10, prefix="_tile_", replace=False
    )
    return out.withColumnsRenamed({f"_tile_{c}": name for name, c in deciles.items()})


def bank_features(df: DataFrame) -> DataFrame:
    """All row-wise derived columns of the bank snapshot."""
    df = scale_new_customers(df, "ctrx_quarter", "cliente_antiguedad")
    return add_ratios(add_extremes(add_totals(df, TOTALS), EXTREMES), RATIOS)
