"""Model parameters.

The numbers below are fixed domain values (rates, tax brackets, thresholds, word
patterns). They are stated as plain data and passed into the operators; nothing in
``operators`` or ``functions`` hard-codes one.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values: size bands in useful square metres, closed below and open above
RENT_BANDS = ((0, 25), (25, 35), (35, 50), (50, 70), (70, 100), (100, 140))
MICRO_BANDS = (
    ("<25", 0.0, 25.0),
    ("25-35", 25.0, 35.0),
    ("35-50", 35.0, 50.0),
    ("50-70", 50.0, 70.0),
    ("70+", 70.0, 10_000.0),
)

# --- fixed values: text patterns (case-insensitive)
NOT_COMPARABLE_PATTERN = (
    r"amoblad|amueblad|corta[\s-]estad[ií]a|por[\s-]d[ií]a|airbnb|temporada|"
    r"turistic|tur[ií]stic|diario"
)
DOUBTFUL_PATTERN = r"equipad|gc[\s-]incl|gastos[\s-]comunes[\s-]inclu"
NUMBER_PATTERN = r"\d[\d.]*(?:,\d+)?"

# --- fixed values: personal-data patterns used for redaction, in order of application
# (name, pattern, replacement, literals of which every match contains at least one)
REDACTION_PATTERNS = (
    ("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[correo-removido]", ("@",)),
    ("chat", r"(?:wa\.me|api\.whatsapp\.com)[^\"'>\s]*", "[whatsapp-removido]", ("wa.me", "api.whatsapp.com")),
    ("tel", r"tel:[^\"'>\s]*", "tel:[removido]", ("tel:",)),
    ("phone", r"\+\s?56[\s.\-]?9?[\s.\-]?\d[\d\s.\-]{5,10}\d", "[fono-removido]", ("+",)),
)
LOOSE_PHONE_PATTERN = r"(?<!\d)(?<!MLC-)9\d{8}(?!\d)"
PII_SCAN_PATTERNS = (
    ("email", r"[\w.+-]+@[\w-]+\.[\w.]{2,}"),
    ("phone", r"(?<!\d)(?<!MLC-)(?:\+?56[\s.-]?)?9[\s.-]?\d{4}[\s.-]?\d{4}(?!\d)"),
    ("tax_id", r"(?<!\d)\d{1,2}\.?\d{3}\.?\d{3}[-‐][\dkK](?![\w-])"),
)
COMPANY_TAX_ID_FROM = 60_000_000

# --- fixed values: plausible ranges of a listing price, by (operation, currency)
PRICE_RANGES = (
    ("sale", "UF", 500.0, 60_000.0),
    ("sale", "CLP", 20_000_000.0, 3_000_000_000.0),
    ("rent", "CLP", 50_000.0, 5_000_000.0),
    ("rent", "UF", 1.0, 150.0),
)

# --- fixed values: building fees in CLP per m2 and month
FEES_BY_MUNICIPALITY = {
    "santiago": 2200.0,
    "estacion-central": 2200.0,
    "nunoa": 3000.0,
    "san-miguel": 2800.0,
    "la-florida": 2600.0,
    "providencia": 4200.0,
    "las-condes": 5500.0,
}
FEES_DEFAULT = 3000.0

SCORE_WEIGHTS = {
    "holding_cost": 0.30,
    "breakeven_down": 0.20,
    "irr_10y": 0.20,
    "zone_risk": 0.15,
    "catalyst": 0.10,
    "zone_discount": 0.05,
}

PROVENANCE_COLUMNS = (
    "source_id",
    "source_url",
    "fetched_at",
    "parser_version",
    "raw_blob_path",
    "robots_snapshot_sha",
)


@dataclass(frozen=True)
class Params:
    # comparables and matching
    bands: tuple = RENT_BANDS
    min_comparables: int = 8
    fresh_days: int = 21
    asof_days: int = 7
    furnished_max_m2: float = 140.0
    window_factors: tuple = (0.20, 0.30, 0.40)
    window_floor_m2: float = 3.0
    off_centre_max: float = 0.20
    seasonal_max: float = 0.30
    seasonal_min_count: int = 2
    wide_shift_max: float = 0.15
    core_min: int = 3
    yardstick_elasticity: float = 0.45
    smaller_min: int = 3
    smaller_factor: float = 0.85
    size_shift_mark: float = 0.05
    # plausibility of a sale unit
    price_range: tuple = (500.0, 60_000.0)
    m2_range: tuple = (15.0, 400.0)
    uf_m2_range: tuple = (20.0, 200.0)
    # suspicious rows
    promo_min: int = 3
    promo_factor: float = 0.75
    promo_peer_band: float = 0.25
    promo_min_peers: int = 5
    fence_iqr: float = 3.0
    fence_floor: float = 0.10
    fence_min: int = 3
    # gates
    coverage_min: float = 0.80
    anchor_rent_max: float = 0.25
    dedup_days: int = 30
    drop_trigger: float = 0.30
    # macro and loan
    uf_clp: float = 40_804.0
    inflation: float = 0.03
    discount_rate: float = 0.06
    loan_years: int = 30
    ltv_guaranteed: float = 0.90
    ltv_plain: float = 0.80
    rate_subsidised: float = 0.0330
    rate_best_plain: float = 0.0429
    rate_plain_average: float = 0.0397
    subsidy_price_cap: float = 6000.0
    guarantee_covers_used: bool = False
    down_options: tuple = (0.10, 0.15, 0.20)
    down_base: float = 0.10
    qualifies_subsidy: bool = True
    require_tax_regime: bool = True
    income_share_max: float = 0.25
    debt_share_max: float = 0.45
    # closing costs
    stamp_tax: float = 0.008
    closing_fixed_uf: float = 3.5 + 3.0 + 4.0 + 3.0
    closing_fixed_clp: float = 165_000.0 + 50_000.0
    fitting_out_uf: float = 25.0
    # income
    vacancy_individual: float = 0.08
    vacancy_professional: float = 0.045
    bad_debt: float = 0.02
    tenant_years: float = 2.0
    # running costs
    fees_default: float = FEES_DEFAULT
    fees_by_municipality: dict = field(default_factory=lambda: dict(FEES_BY_MUNICIPALITY))
    property_tax_low: float = 0.00893
    property_tax_high: float = 0.01042
    property_tax_cut_clp: float = 220_398_431.0
    property_tax_exempt_clp: float = 61_711_570.0
    assessed_ratio: float = 0.55
    regime_tax_rebate: float = 0.50
    regime_window_years: tuple = ((70.0, 20), (100.0, 15), (140.0, 10))
    upkeep_pct: float = 0.05
    life_insurance_monthly: float = 0.00035
    fire_insurance_monthly: float = 0.00028
    letting_fee_months: float = 0.595
    management_pct: float = 0.07
    sale_fee_pct: float = 0.03
    vat: float = 0.19
    # taxes
    regime_max_m2: float = 140.0
    regime_probable: bool = True
    income_tax_marginal: float = 0.23
    gain_exempt_uf: float = 8000.0
    gain_tax: float = 0.10
    appreciation: float = 0.025
    irr_horizons: tuple = (10, 20, 30)
    irr_bounds: tuple = (-0.9999, 10.0)
    # exclusions
    price_max_uf: float = 6000.0
    m2_max: float = 140.0
    only_new: bool = False
    exclude_saturated: bool = True
    exclude_estimated: bool = True
    deficit_max_clp: float | None = 400_000.0
    # break-even searches
    down_search_max: float = 0.95
    down_search_tol: float = 0.0005
    rent_search_factor: float = 8.0
    rent_search_tol: float = 0.01
    # score
    score_weights: dict = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    # zone risk and station catalyst
    risk_weights: tuple = (0.5, 0.3, 0.2)  # vacancy, saturation, rental depth
    catalyst_full_m: float = 400.0
    catalyst_max_m: float = 1200.0
    catalyst_building: float = 0.7
    catalyst_open: float = 1.0
    catalyst_horizon_years: int = 3
    zone_max_distance_m: float = 2500.0
    # rent model for thin cells
    hedonic_min_obs: int = 100
    hedonic_min_cells: int = 12
    hedonic_min_support: int = 8
    hedonic_min_obs_typ: int = 30
    hedonic_shrink: float = 8.0
    hedonic_max_iter: int = 500
    hedonic_tol: float = 1e-9
    backtest_median_max: float = 0.10
    backtest_p75_max: float = 0.15
    backtest_min_cells: int = 40

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def deficit_max_uf(self) -> float | None:
        return None if self.deficit_max_clp is None else self.deficit_max_clp / self.uf_clp

    @property
    def erosion(self) -> float:
        return 1.0 / (1.0 + self.inflation / 2.0)


DEFAULT = Params()
