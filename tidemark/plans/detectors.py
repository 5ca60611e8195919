"""Event rules as boolean expressions over the feature panel; the same text runs on Spark and on DuckDB."""

from __future__ import annotations

from .panel import STEP_MINUTES, lagged, pq

#: Lagged columns and sliding extrema that rules need, added before the rules are looked at.
HELPERS: dict[str, str] = {
    "prev_rv_z": lagged("rv_z", 1), "prev_rv_z_pq950": lagged(pq("rv_z", 0.95), 1), "prev_abs_ret": lagged("abs_ret", 1), "prev_abs_ret_pq950": lagged(pq("abs_ret", 0.95), 1), "prev_ret": lagged("ret_1", 1),
    "prev_ratio": lagged("ratio_now", 1), "prev_funding": lagged("funding", 1), "prev_abs_trend": lagged("abs_trend", 1), "prev_trend": lagged("trend", 1),
    "prev_abs_trend_pq700": lagged(pq("abs_trend", 0.7), 1), "prev_abs_trend_pq350": lagged(pq("abs_trend", 0.35), 1), "prev_rv": lagged("rv", 1), "prev_rv_pq660": lagged(pq("rv", 0.66), 1), "prev_rv_pq330": lagged(pq("rv", 0.33), 1), "prev_spread_z": lagged("spread_z", 1),
    "hh": "hour(ts)", "dd": "day(ts)", "mm": "minute(ts)", "oi_change": f"oi / nullif({lagged('oi', 1)}, 0) - 1",
}

#: Name -> (rule, bars between kept hits). An unknown value makes a rule false.
RULES: dict[str, tuple[str, int]] = {
    "DEPTH_COLLAPSE": (f"spread_z >= {pq('spread_z', 0.9)} AND rv_z >= {pq('rv_z', 0.7)}", 6),
    "SPREAD_BLOWOUT": (f"spread_z >= greatest(coalesce({pq('spread_z', 0.97)}, 2.0), 2.0)", 6),
    "ORDERFLOW_IMBALANCE_SHOCK": (f"abs_ret >= {pq('abs_ret', 0.99)} AND rv_z >= {pq('rv_z', 0.7)}", 6),
    "SWEEP_STOPRUN": (f"wick >= {pq('wick', 0.97)} AND abs_ret >= {pq('abs_ret', 0.9)}", 6),
    "ABSORPTION_EVENT": (f"abs_ret <= {pq('abs_ret', 0.35)} AND spread_z >= {pq('spread_z', 0.8)}", 6),
    "LIQUIDITY_GAP_PRINT": (f"abs_ret >= {pq('abs_ret', 0.995)}", 6),
    "VOL_SPIKE": (f"rv_z >= greatest(coalesce({pq('rv_z', 0.97)}, 2.0), 2.0)", 6),
    "VOL_RELAXATION_START": (f"prev_rv_z >= prev_rv_z_pq950 AND rv_z < {pq('rv_z', 0.7)} AND rv_z < prev_rv_z", 6),
    "VOL_CLUSTER_SHIFT": (f"rv_step >= {pq('rv_step', 0.98)}", 6),
    "RANGE_COMPRESSION_END": ("prev_ratio <= 0.8 AND ratio_now >= 0.95", 6),
    "BREAKOUT_TRIGGER": ("(close > top_24 OR close < bottom_24) AND prev_ratio <= 0.85", 6),
    "FUNDING_FLIP": (f"coalesce(sign(funding) <> sign(prev_funding), TRUE) AND abs_funding >= {pq('abs_funding', 0.6)}", 6),
    "DELEVERAGING_WAVE": (f"oi_delta <= {pq('oi_delta', 0.05)} AND rv_z >= {pq('rv_z', 0.7)}", 6),
    "TREND_EXHAUSTION_TRIGGER": (f"abs_trend >= {pq('abs_trend', 0.85)} AND ret_1 * trend <= 0 AND rv_z >= {pq('rv_z', 0.5)}", 6),
    "MOMENTUM_DIVERGENCE_TRIGGER": (f"abs_trend >= {pq('abs_trend', 0.75)} AND abs_ret <= {pq('abs_ret', 0.3)}", 6),
    "CLIMAX_VOLUME_BAR": (f"abs_ret >= {pq('abs_ret', 0.99)} AND rv_z >= {pq('rv_z', 0.9)}", 6),
    "FAILED_CONTINUATION": ("prev_abs_ret >= prev_abs_ret_pq950 AND ret_1 * prev_ret < 0", 6),
    "RANGE_BREAKOUT": (f"(close > prev_high OR close < prev_low) AND rv >= {pq('rv', 0.5)}", 6),
    "FALSE_BREAKOUT": (f"broke_before = 1 AND close <= prev_high AND close >= prev_low AND abs_ret >= {pq('abs_ret', 0.4)}", 6),
    "TREND_ACCELERATION": (f"abs_trend >= {pq('abs_trend', 0.7)} AND trend_step >= {pq('trend_step', 0.9)} AND sign(ret_mean_3) = sign(trend)", 6),
    "TREND_DECELERATION": (f"prev_abs_trend >= prev_abs_trend_pq700 AND trend_step <= {pq('trend_step', 0.1)} AND ret_1 * prev_trend <= 0", 6),
    "PULLBACK_PIVOT": (f"prev_abs_trend >= prev_abs_trend_pq700 AND ret_1 * prev_trend < 0 AND abs_ret >= {pq('abs_ret', 0.4)} AND abs_ret <= {pq('abs_ret', 0.75)} AND bar_range <= {pq('bar_range', 0.8)}", 6),
    "SUPPORT_RESISTANCE_BREAK": (f"(close > top_48 OR close < bottom_48) AND rv >= {pq('rv', 0.6)}", 6),
    "ZSCORE_STRETCH": (f"abs_px_z >= greatest(coalesce({pq('abs_px_z', 0.96)}, 2.0), 2.0)", 6),
    "BAND_BREAK": ("close > mean_24 + 2 * sd_24 OR close < mean_24 - 2 * sd_24", 6),
    "OVERSHOOT_AFTER_SHOCK": (f"prev_rv_z >= prev_rv_z_pq950 AND abs_px_z >= {pq('abs_px_z', 0.95)}", 6),
    "GAP_OVERSHOOT": (f"abs_ret >= {pq('abs_ret', 0.995)}", 6),
    "VOL_REGIME_SHIFT_EVENT": (f"(rv > {pq('rv', 0.66)} AND prev_rv <= prev_rv_pq660) OR (rv < {pq('rv', 0.33)} AND prev_rv >= prev_rv_pq330)", 6),
    "TREND_TO_CHOP_SHIFT": (f"prev_abs_trend >= prev_abs_trend_pq700 AND abs_trend <= {pq('abs_trend', 0.35)} AND rv <= {pq('rv', 0.35)}", 6),
    "CHOP_TO_TREND_SHIFT": (f"prev_abs_trend <= prev_abs_trend_pq350 AND abs_trend >= {pq('abs_trend', 0.7)} AND rv >= {pq('rv', 0.7)}", 6),
    "CORRELATION_BREAKDOWN_EVENT": (f"abs_basis_z >= {pq('abs_basis_z', 0.92)} AND abs_spread_z >= {pq('abs_spread_z', 0.8)} AND ret_1 * basis_z < 0", 6),
    "BETA_SPIKE_EVENT": (f"abs_ret >= {pq('abs_ret', 0.99)} AND abs_basis_z >= {pq('abs_basis_z', 0.85)} AND rv >= {pq('rv', 0.7)}", 6),
    "INDEX_COMPONENT_DIVERGENCE": (f"abs_basis_z >= {pq('abs_basis_z', 0.93)} AND abs_ret >= {pq('abs_ret', 0.75)}", 6),
    "SPOT_PERP_BASIS_SHOCK": (f"abs_basis_z >= greatest(coalesce({pq('abs_basis_z', 0.97)}, 2.0), 2.0)", 6),
    "LEAD_LAG_BREAK": (f"basis_step >= {pq('basis_step', 0.99)}", 6),
    "SESSION_OPEN_EVENT": (f"hh IN (0, 8, 13) AND mm < {STEP_MINUTES}", 1),
    "SESSION_CLOSE_EVENT": (f"hh IN (7, 12, 23) AND mm + {STEP_MINUTES} >= 60", 1),
    "FUNDING_TIMESTAMP_EVENT": (f"hh IN (0, 8, 16) AND mm < {STEP_MINUTES}", 1),
    "SCHEDULED_NEWS_WINDOW_EVENT": (f"hh IN (12, 13, 14, 18) AND mm + {STEP_MINUTES} > 25 AND mm <= 35", 1),
    "SPREAD_REGIME_WIDENING_EVENT": (f"spread_z >= greatest(coalesce({pq('spread_z', 0.97)}, 2.0), 2.0) AND spread_z > prev_spread_z", 3),
    "SLIPPAGE_SPIKE_EVENT": (f"spread_z >= {pq('spread_z', 0.93)} AND abs_ret >= {pq('abs_ret', 0.9)} AND bar_range >= {pq('bar_range', 0.9)} AND rv >= {pq('rv', 0.7)}", 3),
    "FEE_REGIME_CHANGE_EVENT": (f"hh = 0 AND dd = 1 AND mm < {STEP_MINUTES}", 3),
    "OI_SPIKE_POSITIVE": ("oi_z >= 2.5 AND ret_1 > 0", 1),
    "OI_SPIKE_NEGATIVE": ("oi_z >= 2.5 AND ret_1 < 0", 1),
    "OI_FLUSH": ("oi_change <= -0.005", 1),
    "LIQUIDITY_SHOCK": ("quote_volume < 0.5 * vol_base AND bar_range > 2 * range_base", 12),
    "FND_DISLOC": ("abs_funding > 0.0002", 12),
}
