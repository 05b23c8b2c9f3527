"""Default macro methodology, so that existing panels score without a configuration file."""

from __future__ import annotations

from panelscore.model import Indicator, Model, Preset, ScoringParams
from panelscore.operators.derive import Derivation

MACRO = "Macro Growth & Inflation"
FISCAL = "Fiscal Sustainability"
EXTERNAL = "External Vulnerability"
MONETARY = "Monetary & Currency Stability"
BANKING = "Banking & Financial Sector Health"

# Code, pillar, weight, direction, label, category, unit, source, low, high, phrases.
DEFAULT_INDICATORS = (
    Indicator("FP.CPI.TOTL.ZG", MACRO, 0.10, 1, "Inflation", "Prices", "% YoY", "world_bank", -20, 100,
              "Elevated inflation", "Contained inflation"),
    Indicator("NY.GDP.MKTP.KD.ZG", MACRO, 0.11, -1, "Real GDP growth", "Growth", "% YoY", "world_bank", -40, 30,
              "Weakening growth", "Resilient growth"),
    Indicator("SL.UEM.TOTL.ZS", MACRO, 0.03, 1, "Unemployment", "Labor", "% of labor force", "world_bank", 0, 100,
              "High unemployment", "Tight labor market"),
    Indicator("OUTPUT_GAP_PROXY_PCT", MACRO, 0.02, -1, "Output-gap proxy", "Growth", "pp of GDP", "derived", -40, 40,
              "Output below trend", "Output above trend"),
    Indicator("GC.DOD.TOTL.GD.ZS", FISCAL, 0.14, 1, "Public debt", "Fiscal", "% of GDP", "world_bank", 0, 500,
              "High public debt", "Contained public debt"),
    Indicator("GC.NLD.TOTL.GD.ZS", FISCAL, 0.05, -1, "Budget balance", "Fiscal", "% of GDP", "world_bank", -100, 100,
              "Large fiscal deficit", "Fiscal surplus"),
    Indicator("PUBLIC_DEBT_TRAJECTORY_PCT", FISCAL, 0.03, 1, "Public-debt trajectory", "Fiscal",
              "pp of GDP (3y change)", "derived", -500, 500, "Fast-rising debt burden", "Stable or declining debt"),
    Indicator("BN.CAB.XOKA.GD.ZS", EXTERNAL, 0.06, -1, "Current account balance", "External", "% of GDP", "world_bank",
              -100, 100, "Current account deficit pressure", "Current account surplus cushion"),
    Indicator("FI.RES.TOTL.MO", EXTERNAL, 0.07, -1, "FX reserves", "External", "months of imports", "world_bank", 0, 500,
              "Thin FX-reserve buffer", "Ample FX reserves"),
    Indicator("DT.DOD.DECT.GN.ZS", EXTERNAL, 0.05, 1, "External debt", "External", "% of GNI", "world_bank", 0, 1000,
              "High external debt burden", "Low external debt burden"),
    Indicator("NE.RSB.GNFS.ZS", EXTERNAL, 0.02, -1, "Trade balance", "External", "% of GDP", "world_bank", -100, 100,
              "Trade balance deficit", "Trade surplus"),
    Indicator("FX_YOY_DEPRECIATION_PCT", MONETARY, 0.10, 1, "Currency depreciation", "FX", "% YoY", "derived", -100, 500,
              "Currency depreciation", "Currency strength"),
    Indicator("POLICY_RATE_YOY_CHANGE_BPS", MONETARY, 0.0, 1, "Policy-rate change", "Monetary", "basis points YoY",
              "fred_us_only", -1000, 1000, "Rapid policy tightening", "Easing monetary stance"),
    Indicator("FX_LEVEL_USD_LCU", MONETARY, 0.0, 1, "Nominal FX level to USD", "FX", "LCU per USD", "World Bank", 0, 100000),
    Indicator("FX_TREND_DEVIATION_PCT", MONETARY, 0.0, 1, "FX deviation from long-run trend", "FX", "% vs 5-yr trend",
              "derived", -100, 500),
    Indicator("IMF_REAL_EFFECTIVE_EXCHANGE_RATE", MONETARY, 0.0, 1, "Real effective exchange rate", "FX",
              "index, log change", "imf_ifs", -100, 100),
    Indicator("FB.AST.NPER.ZS", BANKING, 0.10, 1, "Non-performing loans", "Banking", "% of gross loans", "world_bank", 0,
              100, "Rising bad loans in the banking sector", "Healthy loan books"),
    Indicator("BIS_CREDIT_GAP", BANKING, 0.0, 1, "Credit-to-GDP gap", "Banking", "pp of GDP", "bis", -100, 200,
              "Credit-boom warning signal", "Subdued credit growth"),
    Indicator("COMMODITY_PRICE_INDEX_PCT", EXTERNAL, 0.0, 1, "Commodity-price index (global)", "Terms of trade", "% YoY",
              "fred_global", -100, 100),
    Indicator("FI.RES.XGLD.CD", EXTERNAL, 0.0, -1, "Total reserves minus gold", "External", "current US$", "world_bank",
              0, 1e14),
    Indicator("DT.DOD.DSTC.CD", EXTERNAL, 0.0, 1, "Short-term external debt", "External", "current US$", "world_bank", 0,
              1e13),
    Indicator("RESERVES_TO_SHORT_TERM_DEBT_RATIO", EXTERNAL, 0.0, -1, "Reserves-to-short-term-debt ratio", "External",
              "x (reserves / short-term external debt)", "derived", 0, 100),
)
DEFAULT_MODEL = Model(
    indicators=DEFAULT_INDICATORS,
    pillar_weights={MACRO: 0.26, FISCAL: 0.22, EXTERNAL: 0.20, MONETARY: 0.16, BANKING: 0.16},
    sectors={"Macro & Fiscal Sector": (MACRO, FISCAL), "Financial & External Sector": (EXTERNAL, MONETARY, BANKING)},
    sector_weights={"Macro & Fiscal Sector": 0.55, "Financial & External Sector": 0.45},
    params=ScoringParams(sector_composite_weight=0.30),
)

# The derived series and what they come from.
DEFAULT_DERIVATIONS = (
    Derivation("OUTPUT_GAP_PROXY_PCT", "NY.GDP.MKTP.KD.ZG", "trailing_gap"),
    Derivation("PUBLIC_DEBT_TRAJECTORY_PCT", "GC.DOD.TOTL.GD.ZS", "lag3"),
    Derivation("FX_TREND_DEVIATION_PCT", "FX_LEVEL_USD_LCU", "centered"),
    Derivation("RESERVES_TO_SHORT_TERM_DEBT_RATIO", "FI.RES.XGLD.CD", "ratio", other="DT.DOD.DSTC.CD"),
)

# The named shocks.
DEFAULT_PRESETS = (
    Preset("rate_hike", "Rate shock (+100bps)", "POLICY_RATE_YOY_CHANGE_BPS", 100.0,
           ("FX_YOY_DEPRECIATION_PCT", "NY.GDP.MKTP.KD.ZG", "GC.DOD.TOTL.GD.ZS"), "bps", "policy-rate"),
    Preset("growth_slowdown", "Growth shock (−2pp GDP)", "NY.GDP.MKTP.KD.ZG", -2.0,
           ("SL.UEM.TOTL.ZS", "GC.NLD.TOTL.GD.ZS", "BN.CAB.XOKA.GD.ZS"), "pp", "real-GDP-growth"),
    Preset("fx_devaluation", "FX shock (20% devaluation)", "FX_YOY_DEPRECIATION_PCT", 20.0,
           ("FP.CPI.TOTL.ZG", "FI.RES.TOTL.MO", "DT.DOD.DECT.GN.ZS", "NE.RSB.GNFS.ZS"), "pp", "currency-depreciation"),
    Preset("commodity_collapse", "Commodity shock (exporters)", "COMMODITY_PRICE_INDEX_PCT", -20.0,
           ("BN.CAB.XOKA.GD.ZS", "NE.RSB.GNFS.ZS", "FX_YOY_DEPRECIATION_PCT"), "%", "commodity-price"),
    Preset("banking_stress", "Banking stress (credit gap)", "BIS_CREDIT_GAP", 10.0,
           ("FB.AST.NPER.ZS", "NY.GDP.MKTP.KD.ZG", "FX_YOY_DEPRECIATION_PCT"), "pp", "credit-to-GDP-gap"),
)
DEFAULT_PEERS = {
    "advanced": ("USA", "CAN", "GBR", "DEU", "FRA", "ITA", "ESP", "JPN", "KOR", "AUS", "NLD", "SGP", "GRC"),
    "emerging": ("IND", "CHN", "BRA", "MEX", "ZAF", "IDN", "TUR", "POL", "ARG", "RUS"),
}


def preset(key: str, presets=DEFAULT_PRESETS) -> Preset:
    for p in presets:
        if p.key == key:
            return p
    raise ValueError(f"unknown preset '{key}'; known: {', '.join(p.key for p in presets)}")
