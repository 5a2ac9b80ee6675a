"""Names, word lists, limits and texts that results are defined by."""

# ---- canonical columns of the four tables -------------------------------
EXPECTED = {
    "inspection": ["unit_id", "batch_id", "variant", "timestamp", "label", "defect_category"],
    "process": ["batch_id", "timestamp", "temperature", "speed", "pressure", "vibration"],
    "production": [
        "station", "batch_id", "cycle_time", "capacity", "wip", "downtime_hours",
        "units_in", "units_out", "rework_units", "scrap_units",
    ],
    "economic": [
        "unit_price", "material_cost", "labor_cost", "overhead_cost",
        "scrap_cost", "rework_cost", "downtime_cost_per_hour",
    ],
}
TEXT_COLUMNS = ["unit_id", "batch_id", "variant", "timestamp", "label", "defect_category", "station"]
TELEMETRY = ["temperature", "speed", "pressure", "vibration"]
MEASUREMENTS = ["roughness_ra", "dimension_delta_mm", "optical_score"]
PRODUCTION_NUMBERS = [
    "cycle_time", "capacity", "wip", "downtime_hours", "units_in", "units_out", "rework_units", "scrap_units",
]

# ---- column aliases, per table ------------------------------------------
ALIASES = {
    "inspection": {
        "unit_id": ["id", "part_id", "item_id", "serial_number"],
        "batch_id": ["batch", "lot_id"],
        "variant": ["model", "variant_id", "product_type", "product"],
        "timestamp": ["time", "date", "datetime", "inspection_time"],
        "label": ["is_defective", "defective", "has_defect", "defect", "status", "pass_fail", "result"],
        "defect_category": ["defect_family", "defect_type", "defect_class", "category", "failure_mode"],
        "image_path": ["image", "file_path", "filename", "img"],
        "bbox": ["bounding_box", "box"],
    },
    "process": {
        "batch_id": ["batch", "lot_id"],
        "timestamp": ["time", "date", "datetime"],
        "temperature": ["temp", "temp_c", "heater_temp", "temp_zone_1", "temp_zone_2"],
        "speed": ["feed_rate", "feed_rate_m_min", "line_speed", "rpm"],
        "pressure": ["press", "pressure_bar", "hydraulic_pressure"],
        "vibration": ["vib", "vibration_mm_s", "vib_level"],
    },
    "production": {
        "station": ["station_id", "station_name", "machine", "workstation", "line_station"],
        "batch_id": ["batch", "lot_id"],
        "cycle_time": ["ct", "cycle_time_sec", "process_time"],
        "capacity": ["nominal_capacity", "nominal_capacity_uph", "uph", "max_capacity"],
        "wip": ["wip_count", "in_process", "queue_count", "buffer"],
        "downtime_hours": ["downtime", "down_time", "downtime_min"],
        "units_in": ["input_units", "arrivals"],
        "units_out": ["output_units", "completed"],
        "rework_units": ["rework", "reworked"],
        "scrap_units": ["scrap", "scrapped"],
    },
    "economic": {
        "unit_price": ["price", "selling_price", "revenue_per_unit"],
        "material_cost": ["material", "raw_material"],
        "labor_cost": ["labor", "labor_rate", "labor_rate_hourly"],
        "overhead_cost": ["overhead", "overhead_rate", "overhead_rate_hourly"],
        "scrap_cost": ["scrap_penalty", "scrap_penalty_per_unit"],
        "rework_cost": ["rework", "rework_cost_per_unit"],
        "downtime_cost_per_hour": ["downtime_penalty", "downtime_cost", "downtime_penalty_hourly"],
    },
}
MINUTE_ALIASES = ["downtime_min"]  # aliases of an hours column that hold minutes

# ---- words ---------------------------------------------------------------
DEFECTIVE_WORDS = ["1", "1.0", "true", "t", "defective", "defect", "fail", "failed", "ng", "bad"]
NO_CATEGORY_WORDS = ["none", "good", "nan", ""]
IMAGE_CLASSES = ["normal", "crack", "hole", "rust", "scratch"]
NORMAL_CLASS = "normal"
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "bmp", "tiff"]

# ---- defaults for missing values ----------------------------------------
DEFAULT_CATEGORY = "None"
DEFAULT_VARIANT = "Standard-Variant"
DEFAULT_STATION = "Unassigned Station"
DEFAULT_TIMESTAMP = "2026-09-19 08:00:00"
FIRST_FALLBACK_UNIT = 1000
ECONOMIC_DEFAULTS = {
    "unit_price": 85.0,
    "material_cost": 32.0,
    "labor_cost": 45.0,
    "overhead_cost": 30.0,
    "scrap_cost": 42.0,
    "rework_cost": 18.5,
    "downtime_cost_per_hour": 150.0,
}

# ---- limits --------------------------------------------------------------
SHIFT_HOURS = 8.0
DEFAULT_WORKERS = 10
UNCERTAIN_BELOW = 0.70
NOVEL_Z = 2.8
NEIGHBOURS = 5
NOVELTY_PERCENTILE = 0.95
ANOMALY_PERCENTILE = 0.99
EMPTY_NOVELTY_THRESHOLD = 0.50
EMPTY_ANOMALY_THRESHOLD = 1.85
BANK_ROWS = 30_000
WILSON_Z = 1.959963984540054
ALERT_RATIO = 1.2
SMALL_SAMPLE = 25
SIGNIFICANCE = 0.05

# ---- texts ---------------------------------------------------------------
BBOX_PRESENT = "Verified Spatial Annotation (Ground Truth Bounding Box)"
BBOX_HEATMAP = "Approximate Synthetic Feature Attribution Heatmap"
BBOX_ABSENT = "No Annotation Available"
SIMULATED = "Simulated / advisory"
ADVISORY_STATUS = "SIMULATED / ADVISORY"
INSUFFICIENT = "insufficient data"
FACTOR_DISCLAIMER = "All findings are statistical associations / likely contributing factors, not proven causes."
TRIAGE_TEXT = {
    "NOVEL": "🚨 Novel Signature: Engineering Root-Cause Review",
    "UNCERTAIN": "⚠️ Borderline Confidence: Human Inspector Sign-Off Required",
    "REJECT": "❌ Automated Reject: Route to %s Rework/Scrap",
    "ACCEPT": "✅ Conforming: Direct to Downstream Packaging",
}
SPLIT_TRIAGE_TEXT = {
    "UNCERTAIN": "Route to Human Inspector (Borderline Confidence)",
    "REJECT": "Direct Scrappage / Rework Line",
    "ACCEPT": "Direct Shipment (Conforming)",
}
WHY_NOVEL = (
    "NOVEL / UNKNOWN: Novelty score %.3f exceeds threshold %.3f (k=%d nearest-neighbor train distance). "
    "Feature embedding is out-of-distribution across all %d known classes. "
    "Triage recommended for unseen defect characterization."
)
WHY_UNCERTAIN = (
    "UNCERTAIN: Calibrated confidence %.2f (%s) is below threshold %.2f. "
    "Top-2 competing classes: %s (%.1f%%) and %s (%.1f%%). "
    "Prediction is ambiguous; routed to human inspector triage queue."
)
WHY_DEFECTIVE = (
    "DEFECTIVE (%s): Calibrated confidence %.2f meets or exceeds threshold %.2f "
    "(top-2 classes: %s %.1f%%, %s %.1f%%); %s."
)
WHY_GOOD = (
    "GOOD (CONFORMING): Calibrated confidence %.2f meets or exceeds threshold %.2f "
    "(top-2 classes: normal %.1f%%, %s %.1f%%); %s."
)
ANOMALY_OVER = "patch-anomaly score %.2f exceeds normal limit %.2f"
ANOMALY_INSIDE = "patch-anomaly score %.2f is within envelope (%.2f)"
ANOMALY_GOOD = "patch-anomaly score %.2f is within normal threshold %.2f"
ANOMALY_MINOR = "minor localized anomaly %.2f vs limit %.2f"

# ---- findings, impact chain and recommendations -------------------------
FLOW_FINDING = (
    "Bottleneck: %s (utilization %.1f%%, WIP %d); rework adds %.1f%% extra load, costing %.1f UPH in lost capacity."
)
FACTOR_FINDING = (
    "Likely contributing factor: %s (Spearman rho=%+.2f, p=%.4f, n=%d batches); "
    "batches with elevated %s averaged %.1f%% defect rate vs %.1f%% in baseline batches."
)
NO_FACTOR_FINDING = "Likely contributing factor: insufficient telemetry data to establish statistical correlation."
COST_FINDING = (
    "Cost of poor quality: $%s (scrap: $%s, rework: $%s, downtime: $%s); "
    "direct margin impact: -%.1f percentage points of gross operating margin."
)
QUALITY_FINDING = (
    "Quality AI inspection: test accuracy %.1f%% (FRR %.1f%%, FAR %.1f%%); "
    "%d borderline units (%.1f%%) isolated to human triage queue."
)
FINDING_CATEGORIES = {
    "flow": ("Bottleneck & Flow", "Direct Operational Line Calculation"),
    "factor": ("Root-Cause Attribution", "Non-Parametric Statistical Association (%s Evidence)"),
    "no factor": ("Root-Cause Attribution", "Data Missing"),
    "cost": ("Plant Economics", "Financial Cost Accounting"),
    "quality": ("Quality AI & Triage", "Held-Out Test Validation"),
}
STAGES = [
    "Top Defect Family", "Likely Contributing Factor", "Primary Line Bottleneck",
    "Throughput Lost", "Cost of Poor Quality", "Gross Margin Impact",
]
ADVICE_CATEGORIES = ["Process Telemetry & Quality Control", "Production Flow & Bottlenecks", "Plant Financials & COPQ"]
ADVICE_TITLES = ["Process Intervention: Restabilize %s", "Bottleneck Relief: Pre-Screen at %s", "Cost Recovery: Mitigate %s COPQ"]
ADVICE_CONFIDENCE = [
    "High (Statistical Association)", "High (Deterministic Line Flow)", "High (Direct P&L Accounting)",
]
ADVICE_ACTIONS = [
    "Recalibrate `%s` PID controllers and enforce tighter operational limits. "
    "Statistical association indicates elevated `%s` drives %s formation (%s).",
    "Install pre-station optical triage upstream of `%s` to intercept defective parts "
    "before they enter the constraint stage (%s).",
    "Prioritize scrap reduction targets on the top defect family to recover direct material costs "
    "and eliminate secondary rework loops.",
]
ADVICE_IMPACTS = [
    "Simulated / advisory: Restoring `%s` to baseline envelope is projected to reduce %s "
    "defects by ~40-60%%, recovering up to ~%.1f UPH of effective line capacity.",
    "Simulated / advisory: Diverting rework from `%s` eliminates the %s rework penalty, "
    "restoring bottleneck effective utilization toward target baseline.",
    "Simulated / advisory: Cutting poor-quality disruptions by 30%% would recover ~$%s "
    "in net operating profit, lifting gross margin by ~%.1f percentage points.",
]
COPQ_RECOVERY = 0.30
