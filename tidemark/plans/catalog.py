"""Named factors: builders that write expressions, and the families of the catalog.

P, O, H, L are prices one step ago, so that a factor dated t uses nothing later than t - 1. Only forward returns look ahead.
"""

from __future__ import annotations

P, O, H, L, V, A, T = (f"Ref(${f}, 1)" for f in ("close", "open", "high", "low", "vol", "amount", "turnover"))  # noqa: E741
R = f"({P} / Ref($close, 2) - 1)"


def momentum(n: int) -> str:
    return f"{P} / Ref($close, {n + 1}) - 1"


def skip_momentum(skip: int, total: int) -> str:
    return f"Ref($close, {skip + 1}) / Ref($close, {total + 1}) - 1"


def positive(x: str) -> str:
    """x where it is above zero, else null."""
    return f"If({x} > 0, {x}, 0 / 0)"


def rsi(n: int) -> str:
    gain, loss = f"Mean(If({R} > 0, {R}, 0), {n})", f"Mean(If({R} < 0, 0 - {R}, 0), {n})"
    return f"100 - 100 / (1 + {gain} / {loss})"


def amihud(n: int, how: str = "Mean") -> str:
    return f"{how}(Abs({R}) / {positive(A)}, {n})"


def forward_return(h: int) -> str:
    return f"Ref($close, {-h}) / $close - 1"


TRUE_RANGE = f"Greater(Greater({H} - {L}, Abs({H} - Ref($close, 2))), Abs({L} - Ref($close, 2)))"
DIF = f"(EMA({P}, 12) - EMA({P}, 26))"
SHORTCUT = f"((2 * ({H} - {L}) - Abs({O} - {P})) / {positive(A)})"

#: Transforms of a theme's components by (family, mode): fields and a window (or two) to an expression as of the same date.
TRANSFORMS = {
    ("level", "direct"): lambda f: f"${f[0]}",
    ("level", "log"): lambda f: f"Log(Greater(${f[0]}, 0.000000000001))",
    ("level", "inverse"): lambda f: f"1 / ${f[0]}",
    ("change", "pct_change"): lambda f, n: f"${f[0]} / Ref(${f[0]}, {n}) - 1",
    ("change", "diff"): lambda f, n: f"Delta(${f[0]}, {n})",
    ("change", "rolling_mean"): lambda f, n: f"Mean(${f[0]}, {n})",
    ("acceleration", "rolling_mean_diff"): lambda f, n, m: f"Mean(${f[0]}, {n}) - Mean(${f[0]}, {m})",
    ("acceleration", "diff_of_diff"): lambda f, n, m: f"Delta(${f[0]}, {n}) - Delta(${f[0]}, {m})",
    ("stability", "rolling_vol"): lambda f, n: f"Std(${f[0]} / Ref(${f[0]}, 1) - 1, {n})",
    ("relative_position", "distance_to_high"): lambda f, n: f"${f[0]} / Max(${f[0]}, {n}) - 1",
    ("relative_position", "distance_to_low"): lambda f, n: f"${f[0]} / Min(${f[0]}, {n}) - 1",
    ("relative_position", "distance_to_limit"): lambda f: f"(${f[1]} - ${f[0]}) / ${f[0]}",
    ("relative_position", "price_to_ma"): lambda f, n: f"${f[0]} / Mean(${f[0]}, {n}) - 1",
    ("ratio_spread", "midpoint"): lambda f: f"(${f[0]} + ${f[1]}) / 2",
    ("ratio_spread", "ratio"): lambda f: f"${f[0]} / ${f[1]}",
    ("ratio_spread", "net_mean"): lambda f, n: f"Mean(${f[0]} - ${f[1]}, {n})",
    ("ratio_spread", "net_over_net"): lambda f, n: f"Mean(${f[0]} - ${f[1]}, {n}) / Abs(Mean(${f[2]} - ${f[3]}, {n}))",
    ("ratio_spread", "net_share"): lambda f, n: f"Mean(${f[0]} - ${f[1]}, {n}) / Mean(${f[2]}, {n})",
    ("persistence", "delta_sum"): lambda f, n: f"Sum(Delta(${f[0]}, 1), {n})",
}


def component(family: str, mode: str, fields: tuple[str, ...], *windows: int) -> str:
    """The expression of one component; an unknown transform raises KeyError."""
    return TRANSFORMS[family, mode](fields, *windows)


FAMILIES: dict[str, dict[str, str]] = {
    "momentum": {f"mom_{n}": momentum(n) for n in (4, 12, 26, 52)} | {
        "mom_skip_4_26": skip_momentum(4, 26), "mom_wma_12": f"WMA({R}, 12)", "mom_ema_12": f"EMA({R}, 12)",
        "mom_overnight_12": f"Mean({O} / Ref($close, 2) - 1, 12)", "mom_intraday_12": f"Mean({P} / {O} - 1, 12)", "mom_high_12": f"Mean(({H} - {O}) / {O}, 12)",
        "mom_low_12": f"Mean(({L} - {O}) / {O}, 12)", "mom_accel_12": f"({momentum(12)}) - (Ref($close, 13) / Ref($close, 25) - 1)",
    },
    "path": {
        "path_route_12": f"If(Sum(Abs({R}), 12) > 0, ({momentum(12)}) / Sum(Abs({R}), 12), 0)", "path_discrete_12": f"Mean(Sign({R}), 12)",
        "path_since_high_12": f"12 - IdxMax({H}, 12)", "path_since_low_12": f"12 - IdxMin({L}, 12)", "path_rank_12": f"Rank({P}, 12)", "path_rank_mean": f"Mean(Rank({P}, 26), 4)",
        "path_up_down_12": f"Sum(If({R} > 0, 1, 0), 12) / 12",
    },
    "reversal": {f"rev_{n}": f"0 - ({momentum(n)})" for n in (1, 2, 4)} | {"rev_max_12": f"Max({R}, 12)", "rev_min_12": f"Min({R}, 12)"},
    "shadow": {
        "shadow_up": f"({H} - Greater({O}, {P})) / {H}", "shadow_down": f"(Less({O}, {P}) - {L}) / {L}", "shadow_wup": f"({H} - {P}) / {H}", "shadow_wdown": f"({P} - {L}) / {L}",
        "shadow_range": f"{H} / {L}", "shadow_up_avg_12": f"Mean(({H} - Greater({O}, {P})) / {H}, 12)", "shadow_down_std_12": f"Std((Less({O}, {P}) - {L}) / {L}, 12)",
        "std_down_12": f"Std(If({R} < 0, {R}, 0 / 0), 12)", "std_up_12": f"Std(If({R} > 0, {R}, 0 / 0), 12)",
    },
    "value": {
        "val_ep": "1 / Ref($pe, 1)", "val_bp": "1 / Ref($pb, 1)", "val_rel_pe_26": "Ref($pe, 1) / Mean(Ref($pe, 1), 26)", "val_pb_change_12": "Ref($pb, 1) / Ref($pb, 13) - 1",
        "val_delta_4": "Ref($pe, 1) - Ref($pe, 5)", "val_slope_12": "Slope(Ref($pb, 1), 12)", "val_stability_12": "0 - Std(Ref($pb, 1), 12)", "val_ratio": "Ref($pe, 1) / Ref($pb, 1)",
    },
    "size": {"size_ln": "Log(Ref($mcap, 1))", "size_ln2": "Power(Log(Ref($mcap, 1)), 2)"},
    "risk": {f"risk_vol_{n}": f"Std({R}, {n})" for n in (4, 12, 26)} | {
        "risk_down_12": f"Std(If({R} < 0, {R}, 0), 12)", "risk_volofvol": f"Std(Std({R}, 4), 12)", "risk_skew_12": f"Skew({R}, 12)", "risk_kurt_26": f"Kurt({R}, 26)",
        "risk_tail_26": f"Quantile({R}, 26, 0.05)", "risk_mdd_26": f"{P} / Max({H}, 26) - 1", "risk_range_12": f"Mean(({H} - {L}) / {P}, 12)", "risk_slope_12": f"Slope({P}, 12) / {P}",
        "risk_mad_12": f"Mad({R}, 12)", "risk_med_12": f"Med({R}, 12)", "risk_resi_12": f"Resi({P}, 12)", "risk_rsq_12": f"Rsquare({P}, 12)", "risk_var_12": f"Var({R}, 12)",
    },
    "liquidity": {
        "liq_turn_12": f"Mean({T}, 12)", "liq_turn_ratio": f"Mean({T}, 4) / Mean({T}, 26)", "liq_turn_std_12": f"Std({T}, 12)", "liq_amihud_12": amihud(12), "liq_amihud_std_12": amihud(12, "Std"),
        "liq_vstd_12": f"Sum({A}, 12) / {positive(f'Std({R}, 12)')}", "liq_shortcut_12": f"Mean({SHORTCUT}, 12)", "liq_cv_12": f"Std({V}, 12) / Mean({V}, 12)", "liq_dollar_12": f"Log(Mean({A}, 12) * 1000)",
        "liq_surge": f"Mean({V}, 4) / Mean({V}, 26)", "liq_turn_skew_26": f"Skew({T}, 26)", "liq_zero_12": f"Sum(If({V} < 20, 1, 0), 12) / 12", "liq_spread_12": f"Mean(({H} - {L}) / (({H} + {L}) / 2), 12)",
    },
    "correlation": {
        "corr_price_turn": f"Corr({T}, {P}, 12)", "corr_price_turn_post": f"Corr(Ref($turnover, 2), {P}, 12)", "corr_price_turn_prior": f"Corr({T}, Ref($close, 2), 12)", "corr_ret_turn": f"Corr({T}, {R}, 12)",
        "corr_ret_dvol": f"Corr(Delta({V}, 1), {R}, 12)", "corr_price_vol": f"Corr({R}, {V} / Ref($vol, 2) - 1, 12)", "cov_ret_turn": f"Cov({T}, {R}, 12)",
    },
    "technical": {
        "tech_rsi_12": rsi(12), "tech_to_ma_12": f"{P} / Mean({P}, 12) - 1", "tech_ma_ratio": f"Mean({P}, 4) / Mean({P}, 26)", "tech_macd_dif": f"{DIF} / {P}", "tech_macd_hist": f"({DIF} - EMA({DIF}, 9)) / {P}",
        "tech_from_high_26": f"{P} / Max({H}, 26) - 1", "tech_from_low_26": f"{P} / Min({L}, 26) - 1", "tech_position_12": f"({P} - Min({L}, 12)) / (Max({H}, 12) - Min({L}, 12))",
        "tech_atr_12": f"Mean({TRUE_RANGE}, 12) / {P}", "tech_bb_12": f"2 * Std({P}, 12) / Mean({P}, 12)", "tech_williams_12": f"(0 - 100) * (Max({H}, 12) - {P}) / (Max({H}, 12) - Min({L}, 12))",
        "tech_intensity_12": f"Mean((2 * {P} - {H} - {L}) / ({H} - {L}), 12)", "tech_obv_slope": f"Slope(Sum(If({R} > 0, {V}, 0 - {V}), 12), 12)",
    },
    "flow": {
        "flow_prop_12": f"Sum(({P} - {O}) * {V}, 12) / {positive(f'Sum({A}, 12)')}", "flow_shift_12": f"Sum(Delta({V}, 1), 12) / Sum(Abs(Delta({V}, 1)), 12)", "flow_excess_12": f"{V} / Mean({V}, 12) - ({momentum(12)})",
        "flow_growth_12": f"{V} / (Ref($vol, 13) + 1) - ({momentum(12)})", "flow_accum_12": f"Sum(Delta({V}, 1), 12)", "flow_days_12": f"Sum(1 - IsNull({V}), 12)",
    },
    "components": {
        "com_size": component("level", "direct", ("mcap",)), "com_log_size": component("level", "log", ("mcap",)), "com_value": component("level", "inverse", ("pb",)),
        "com_change": component("change", "pct_change", ("close",), 4), "com_diff": component("change", "diff", ("pb",), 4), "com_amount": component("change", "rolling_mean", ("amount",), 12),
        "com_accel": component("acceleration", "rolling_mean_diff", ("amount",), 4, 12), "com_accel_diff": component("acceleration", "diff_of_diff", ("turnover",), 4, 12),
        "com_vol": component("stability", "rolling_vol", ("close",), 12), "com_high": component("relative_position", "distance_to_high", ("close",), 26), "com_low": component("relative_position", "distance_to_low", ("close",), 26),
        "com_limit": component("relative_position", "distance_to_limit", ("close", "high")), "com_ma": component("relative_position", "price_to_ma", ("close",), 12),
        "com_mid": component("ratio_spread", "midpoint", ("high", "low")), "com_ratio": component("ratio_spread", "ratio", ("amount", "vol")), "com_net": component("ratio_spread", "net_mean", ("close", "open"), 12),
        "com_net_net": component("ratio_spread", "net_over_net", ("close", "open", "high", "low"), 12), "com_net_share": component("ratio_spread", "net_share", ("close", "open", "high"), 12),
        "com_sum": component("persistence", "delta_sum", ("turnover",), 12),
    },
    "forward": {f"fwd_{h}": forward_return(h) for h in (1, 4, 12)},
}



def at(field: str, back: int = 1) -> str:
    return f"Ref(${field}, {back})"


def ttm(name: str, first: int = 0) -> str:
    """The sum of four quarters from slot `first` on, as known one step ago."""
    return "(" + " + ".join(at(f"{name}_q{k}") for k in range(first, first + 4)) + ")"


def slot(name: str, k: int = 0) -> str:
    return at(f"{name}_q{k}")


def yoy(name: str, k: int = 0) -> str:
    """Growth over the quarter a year before."""
    return f"(({slot(name, k)} - {slot(name, k + 4)}) / Abs({slot(name, k + 4)}))"


def change(ratio) -> str:
    """ratio(0) - ratio(1): a ratio of the newest quarter less that of the one before."""
    return f"{ratio(0)} - {ratio(1)}"


def equity(k: int) -> str:
    return f"({slot('assets', k)} - {slot('debt', k)})"


def sparse(field: str) -> str:
    """A field of events, 0 where nothing happened."""
    return f"If(IsNull({at(field)}) > 0, 0, {at(field)})"


def net(scope: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"{at('buy_' + k)} - {at('sell_' + k)}" for k in scope) + ")"


def gross(scope: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"{at('buy_' + k)} + {at('sell_' + k)}" for k in scope) + ")"


def held(x: str) -> str:
    """x where holdings from abroad are above zero, else null."""
    return f"If({at('nb_ratio')} > 0, {x}, 0 / 0)"


def active(x: str) -> str:
    """x where there is any margin trading, else null."""
    return f"If(Less(IsNull({at('mg_buy')}), IsNull({at('mg_bal')})) > 0, 0 / 0, {x})"


_SCOPES = {k: (k,) for k in ("sm", "md", "lg", "xl")} | {"all": ("sm", "md", "lg", "xl")}
_EVIDENCE = f"(Sum({sparse('revised_up')}, {{n}}) + Sum({sparse('revised_down')}, {{n}}))"
_DIFFUSION = f"If({_EVIDENCE} >= 2, (Sum({sparse('revised_up')}, {{n}}) - Sum({sparse('revised_down')}, {{n}})) / {_EVIDENCE}, 0 / 0)"
_MARGIN = {k: f"(({slot('rev', k)} - {slot('cost', k)}) / {slot('rev', k)})" for k in range(6)}
_DEBT = {k: f"({slot('debt', k)} / {slot('assets', k)})" for k in range(6)}

#: Families over the made fields of wide_panel().
WIDE_FAMILIES: dict[str, dict[str, str]] = {
    "yield": {
        "val_sp": f"1 / {at('ps')}", "val_dividend": f"{at('dv_ttm')} / 100", "val_dividend_ratio": f"{at('dv_ratio')} / 100", "val_ocf": f"{at('ocfps')} / {P}", "val_bps": f"{at('bps')} / {P}",
        "val_rel_ps_26": f"{at('ps')} / Mean({at('ps')}, 26)", "val_peg": f"{at('pe')} / {positive(yoy('ni'))}",
    },
    "pairs": {
        "corr_ret_turn_post": f"Corr(Ref($turnover, 2), {R}, 12)", "corr_ret_turn_prior": f"Corr({T}, Ref($close, 2) / Ref($close, 3) - 1, 12)", "corr_ret_turnd": f"Corr({T} - Ref($turnover, 2), {R}, 12)",
        "corr_ret_turnd_prior": f"Corr({T} - Ref($turnover, 2), Ref($close, 2) / Ref($close, 3) - 1, 12)", "liq_shortcut_std_12": f"Std({SHORTCUT}, 12)", "path_up_ratio_26": f"Sum(If({R} > 0, 1, 0), 26) / 26",
        "liq_volume_ratio_12": f"Mean({at('volume_ratio')}, 12)",
    },
    "order_flow": {f"flow_prop_{s}": f"If(Sum({A}, 12) > 0, Sum({net(k)}, 12) / Sum({A}, 12), 0 / 0)" for s, k in _SCOPES.items()} | {f"flow_shift_{s}": f"If(Sum({gross(k)}, 12) > 0, Sum({net(k)}, 12) / Sum({gross(k)}, 12), 0 / 0)" for s, k in _SCOPES.items()},
    "northbound": {
        "nb_level": at("nb_ratio"), "nb_change_4": f"{at('nb_ratio')} - Ref($nb_ratio, 5)", "nb_change_12": f"{at('nb_ratio')} - Ref($nb_ratio, 13)", "nb_accum_12": f"Sum(Delta({at('nb_ratio')}, 1), 12)", "nb_slope_12": f"Slope({at('nb_ratio')}, 12)",
        "nb_held_change_12": held(f"{at('nb_ratio')} - Ref($nb_ratio, 13)"), "nb_held_level": held(at("nb_ratio")), "nb_prop_change_12": held(f"{at('nb_ratio')} - Mean({at('nb_ratio')}, 12)"),
        "nb_shift_12": f"Sum(Delta({at('nb_value')}, 1), 12) / Sum(Abs(Delta({at('nb_value')}, 1)), 12)", "nb_excess_12": held(f"{at('nb_value')} / Mean({at('nb_value')}, 12) - ({momentum(12)})"),
        "nb_trade_12": held(f"{at('nb_value')} / Mean({at('nb_value')}, 12) / Sum({A}, 12) * 1000000"),
    },
    "margin": {
        "mg_balance": f"{at('mg_bal')} / {at('mcap')}", "mg_net_buy_12": f"Sum({at('mg_buy')}, 12) / Mean({at('mg_bal')}, 12)", "mg_balance_change_12": f"{at('mg_bal')} / Ref($mg_bal, 13) - 1", "mg_buy_prop_12": active(f"Sum({at('mg_buy')}, 12) / Sum({A}, 12)"),
        "mg_balance_growth_12": active(f"{at('mg_bal')} / (Ref($mg_bal, 13) + 1) - ({momentum(12)})"), "mg_sell_prop_12": active(f"Sum({at('mg_sell_vol')} * {at('vwap')}, 12) / Sum({A}, 12)"),
        "mg_sec_prop": active(f"{at('mg_sec_bal')} / {at('float_cap')}"), "mg_sec_growth_12": active(f"{at('mg_sec_bal')} / (Ref($mg_sec_bal, 13) + 1) - ({momentum(12)})"),
    },
    "statement": {
        "q_gross_profit": f"({ttm('rev')} - {ttm('cost')}) / {slot('assets')}", "q_cash": f"{slot('cash')} / {slot('assets')}", "q_research": f"{slot('rd')} / {slot('assets')}", "q_sq_margin": _MARGIN[0], "q_sq_net_margin": f"{slot('ni')} / {slot('rev')}",
        "q_roe": f"{ttm('ni')} / {equity(0)}", "q_roa": f"{ttm('ni')} / {slot('assets')}", "q_accruals": f"0 - ({ttm('ni')} - {ttm('cfo')}) / {slot('assets')}", "q_cfo_margin": f"{ttm('cfo')} / {ttm('rev')}",
        "q_asset_turn": f"{ttm('rev')} / {slot('assets')}", "q_current": f"{slot('cur')} / {slot('curliab')}", "q_quick": f"({slot('cur')} - {slot('inv')}) / {slot('curliab')}", "q_margin_stability": f"0 - Std({_MARGIN[0]}, 52)", "q_margin_trend": f"Slope({_MARGIN[0]}, 52)",
        "q_roe_trend": f"Slope({ttm('ni')} / {equity(0)}, 52)",
    },
    "ttm_change": {
        "d_cfoa": change(lambda k: f"{ttm('cfo', k)} / {slot('assets', k)}"), "d_roa": change(lambda k: f"{ttm('ni', k)} / {slot('assets', k)}"), "d_roe": change(lambda k: f"{ttm('ni', k)} / {equity(k)}"), "d_cash_current": change(lambda k: f"{slot('cash', k)} / {slot('curliab', k)}"),
        "d_cash_sales": change(lambda k: f"{ttm('cfo', k)} / {ttm('rev', k)}"), "d_debt_assets": change(lambda k: _DEBT[k]), "d_current": change(lambda k: f"{slot('cur', k)} / {slot('curliab', k)}"), "d_quick": change(lambda k: f"({slot('cur', k)} - {slot('inv', k)}) / {slot('curliab', k)}"),
        "d_debt_equity": change(lambda k: f"{slot('debt', k)} / {equity(k)}"),
    },
    "growth": {f"g_{n}_yoy": yoy(n) for n in ("rev", "cost", "cfo", "ni")} | {f"g_{n}_accel": f"{yoy(n)} - {yoy(n, 1)}" for n in ("rev", "cfo", "ni")} | {f"g_{n}_ttm": f"{ttm(n)} / {ttm(n, 4)} - 1" for n in ("rev", "cfo", "ni")} | {f"g_{n}_trend": f"Slope({ttm(n)}, 52) / {ttm(n)}" for n in ("rev", "ni")},
    "leverage": {"lev_debt": at("debt_share"), "lev_delever_13": f"0 - ({at('debt_share')} - Ref($debt_share, 14))", "lev_assets": _DEBT[0], "lev_equity": f"{slot('debt')} / {equity(0)}", "lev_delever_q": f"0 - ({_DEBT[0]} - {_DEBT[4]})"},
    "events": {
        "ev_eps_12": f"Sum({sparse('eps_surprise')}, 12)", "ev_rev_12": f"Sum({sparse('rev_surprise')}, 12)", "ev_momentum": f"If(Sum({sparse('eps_surprise')}, 12) > 0, If({momentum(12)} > 0, 1, 0), 0)", "ev_diffusion_12": _DIFFUSION.format(n=12), "ev_diffusion_26": _DIFFUSION.format(n=26),
        "ev_sue": f"({slot('ni')} - {slot('ni', 4)}) / {positive('Std(' + slot('ni') + ' - ' + slot('ni', 4) + ', 104)')}", "ev_sur": f"({slot('rev')} - {slot('rev', 4)}) / {positive('Std(' + slot('rev') + ' - ' + slot('rev', 4) + ', 104)')}",
    },
    "winners": {
        "win_zero_days_26": f"Sum(If(Abs({R}) < 0.001, 1, 0), 26)", "win_spike_4": f"0 - ({T} / Mean({T}, 26)) * ({momentum(4)})", "win_accel_rev": f"Delta({yoy('rev')}, 13)", "win_accel_ni": f"Delta({yoy('ni')}, 13)", "win_accel_cfo": f"Delta({yoy('cfo')}, 13)",
        "win_score": " + ".join(f"({c})" for c in (
            f"{ttm('ni')} > 0", f"{ttm('cfo')} > 0", f"{ttm('ni')} / {slot('assets')} > {ttm('ni', 4)} / {slot('assets', 4)}", f"{ttm('cfo')} > {ttm('ni')}", f"{_DEBT[0]} < {_DEBT[4]}", f"{slot('cur')} / {slot('curliab')} > {slot('cur', 4)} / {slot('curliab', 4)}",
            f"{at('holders')} <= Ref($holders, 53)", f"{_MARGIN[0]} > {_MARGIN[4]}", f"{ttm('rev')} / {slot('assets')} > {ttm('rev', 4)} / {slot('assets', 4)}")),
    },
    "endpoints": {f"end_{f}_{n}": f"Sum({sparse(f)}, {n}) / {at('mcap')} * 1000" for f in ("block_net", "insider_net") for n in (4, 12, 26)} | {f"end_visits_{n}": f"Sum({sparse('visits')}, {n})" for n in (4, 12, 26)}
    | {f"end_{f}_density_26": f"Sum(1 - IsNull({at(f)}), 26) / 26" for f in ("block_net", "insider_net", "visits")} | {f"end_{f}_ema_12": f"EMA({sparse(f)} / {at('mcap')}, 12) * 1000" for f in ("block_net", "insider_net")} | {"end_visits_ema_12": f"EMA({sparse('visits')}, 12)"}
    | {f"end_holders_{n}": f"0 - ({at('holders')} / Ref($holders, {n + 1}) - 1)" for n in (4, 12, 26)} | {"end_visits_surge": f"Sum({sparse('visits')}, 4) / {positive('Sum(' + sparse('visits') + ', 26)')}"},
}
FAMILIES_OF_ALL = FAMILIES | WIDE_FAMILIES

#: Composites: rank averages by date, a weight for each factor, negative where a low value is good.
COMPOSITES: dict[str, dict[str, float]] = {
    "comp_value": {"val_ep": 0.25, "val_bp": 0.25, "val_sp": 0.25, "val_ocf": 0.25}, "comp_yield": {"val_dividend": 0.5, "val_ocf": 0.5}, "comp_momentum": {"mom_12": 0.5, "mom_26": 0.5}, "comp_reversal": {"rev_1": 0.5, "rev_4": 0.5},
    "comp_low_risk": {"risk_vol_12": -0.5, "risk_range_12": -0.5}, "comp_liquidity": {"liq_turn_12": -0.5, "liq_amihud_12": 0.5}, "comp_quality": {"q_roe": 0.4, "q_gross_profit": 0.3, "q_accruals": 0.3}, "comp_cash": {"q_cash": 0.5, "q_cfo_margin": 0.5},
    "comp_growth": {"g_rev_yoy": 0.5, "g_ni_yoy": 0.5}, "comp_accel": {"g_rev_accel": 0.5, "g_ni_accel": 0.5}, "comp_safety": {"lev_assets": -0.5, "q_current": 0.5}, "comp_change": {"d_roa": 0.5, "d_cfoa": 0.5}, "comp_flow": {"flow_prop_lg": 0.5, "flow_prop_xl": 0.5},
    "comp_abroad": {"nb_change_12": 0.5, "nb_accum_12": 0.5}, "comp_margin": {"mg_balance": -0.5, "mg_buy_prop_12": -0.5}, "comp_events": {"ev_eps_12": 0.5, "ev_rev_12": 0.5}, "comp_value_quality": {"val_ep": 0.5, "q_roe": 0.5}, "comp_value_momentum": {"val_bp": 0.5, "mom_12": 0.5},
    "comp_size_value": {"size_ln": -0.5, "val_bp": 0.5}, "comp_quality_low_risk": {"q_roa": 0.5, "risk_vol_12": -0.5}, "comp_all": {"val_ep": 0.2, "q_roe": 0.2, "mom_12": 0.2, "risk_vol_12": -0.2, "g_ni_yoy": 0.2},
}

CATALOG: dict[str, str] = {name: text for family in FAMILIES_OF_ALL.values() for name, text in family.items()}


def category(factor: str) -> str | None:
    """The family of a factor."""
    return next((f for f, names in FAMILIES_OF_ALL.items() if factor in names), None)
