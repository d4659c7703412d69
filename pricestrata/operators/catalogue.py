"""Which columns may be features, and the named lists of them that are compared."""

from __future__ import annotations

from .selection import variants

# The columns of a model table, by where they come from.
LISTING = ("part_name", "quality_grade", "oem_number", "mileage", "brand", "model", "category", "subcategory", "year_start", "year_end", "year_span", "year_mid", "repair_status")
REGISTER = ("model_total_registered", "model_median_vehicle_age", "model_mean_vehicle_age", "model_median_mileage", "model_mean_mileage", "model_median_engine_cc", "model_median_power_kw", "model_median_mass_kg", "brand_total_registered", "brand_median_vehicle_age", "brand_mean_vehicle_age", "brand_median_mileage", "brand_mean_mileage")
LIFECYCLE = ("model_firstreg_total_2014_2026", "model_firstreg_recent_share", "model_firstreg_old_share", "model_firstreg_weighted_year", "model_firstreg_peak_year", "model_firstreg_peak_count", "model_firstreg_year_span", "brand_firstreg_total_2014_2026", "brand_firstreg_recent_share", "brand_firstreg_old_share", "brand_firstreg_weighted_year", "brand_firstreg_peak_year", "brand_firstreg_peak_count", "brand_firstreg_year_span")
REGISTER_MORE = ("model_share_of_market", "model_share_within_brand", "model_share_over_10y", "model_share_over_200k_km", "model_automatic_share", "model_petrol_share", "model_diesel_share", "model_ev_share", "model_hybrid_share", "model_turbo_share", "brand_median_engine_cc", "brand_median_power_kw", "brand_median_mass_kg", "brand_share_of_market", "brand_share_over_10y", "brand_share_over_200k_km", "brand_automatic_share", "brand_petrol_share", "brand_diesel_share", "brand_ev_share", "brand_hybrid_share", "brand_turbo_share")
DYNAMICS = ("times_observed", "observed_span_days", "price_changed_flag", "price_change_count", "absolute_price_change", "relative_price_change_pct")
OFFSETS = ("first_seen_day_offset", "last_seen_day_offset", "listing_midpoint_day_offset")

# Columns that no model takes, dates, and what tells of the time after a listing.
NEVER = ("product_id", "scrape_date", "brand_merge_key", "model_merge_key", "model_family_clean", "model_looks_like_part_taxonomy")
LISTING_DATES = ("first_seen_date", "last_seen_date")
LEAKING = (*DYNAMICS, "price_changed_flag_so_far", "price_change_count_so_far", "absolute_price_change_so_far", "relative_price_change_pct_so_far", "last_seen_day_offset", "listing_midpoint_day_offset")

OEM = "oem_number"


def pools(columns: list[str], target: str = "price") -> dict[str, list[str]]:
    """The lists that variants are cut from. None holds the target, NEVER or raw dates; only `usable` and `chosen` hold what leaks."""
    gone = {target, *NEVER, *LISTING_DATES}
    usable = [c for c in columns if c not in gone]
    there = set(columns)
    known = lambda *lists: [c for own in lists for c in own if c in there]
    chosen = known(LISTING, REGISTER, LIFECYCLE, REGISTER_MORE, DYNAMICS, OFFSETS)
    return {
        "usable": usable,
        "usable_without_offsets": [c for c in usable if c not in OFFSETS],
        "safe": [c for c in usable if c not in LEAKING],
        "chosen": chosen,
        "chosen_safe": [c for c in chosen if c not in LEAKING],
        "lifecycle": known(LISTING, REGISTER, LIFECYCLE),
        "extended": known(LISTING, REGISTER, LIFECYCLE, REGISTER_MORE),
    }


#: What a variant may leave out of its pool, by the end of its name.
EXCLUSIONS = {"": (), "_without_oem": (OEM,), "_without_offsets": OFFSETS, "_without_offsets_or_oem": (*OFFSETS, OEM)}
#: The pools that may be fitted: those without what leaks.
FITTED = ("lifecycle", "extended", "chosen_safe", "safe")


def catalogue(columns: list[str], target: str = "price") -> dict[str, list[str]]:
    """Named feature lists: every pool that may be fitted, with every exclusion. Empty lists go, and of equal ones the first stays."""
    own = pools(columns, target)
    out: dict[str, list[str]] = {}
    for pool in FITTED:
        cut = variants(own[pool], {pool + end: set(gone) for end, gone in EXCLUSIONS.items()})
        out |= {name: found for name, found in cut.items() if found not in out.values()}
    return out


# The lists that each family of models compares, the first one first.
FAMILIES = {
    "boosted": ("lifecycle", "lifecycle_without_oem", "extended", "chosen_safe", "safe", "safe_without_offsets", "safe_without_offsets_or_oem"),
    "forest": ("extended", "extended_without_oem", "chosen_safe", "chosen_safe_without_oem", "safe", "safe_without_oem", "safe_without_offsets", "safe_without_offsets_or_oem"),
}
FAMILIES["linear"] = FAMILIES["forest"]


def family_catalogue(columns: list[str], kind: str, target: str = "price") -> dict[str, list[str]]:
    """The lists of a family in its own order. Empty ones go, and of equal ones the first stays."""
    if kind not in FAMILIES:
        raise ValueError(f"no such family: {kind}")
    own, out = pools(columns, target), {}
    for name in FAMILIES[kind]:
        pool = next(p for p in sorted(FITTED, key=len, reverse=True) if name.startswith(p))
        found = [c for c in own[pool] if c not in EXCLUSIONS[name.removeprefix(pool)]]
        if found and found not in out.values():
            out[name] = found
    return out


# The groups that explanations are summed by, and the prefixes of what the register says.
GROUPS = {
    "part_taxonomy": ("part_name", "category", "subcategory"),
    "vehicle_identity": ("brand", "model"),
    "part_condition": ("quality_grade", "repair_status"),
    "vehicle_age_usage": ("mileage", "mileage_missing_flag", "year_start", "year_end", "year_span", "year_mid"),
    "listing_history": ("observations_so_far", "days_since_first_seen_so_far", "first_seen_day_offset"),
}
PREFIXES = {"model_": "traficom_model_context", "brand_": "traficom_brand_context"}


def feature_groups(columns: list[str]) -> dict[str, str]:
    """The group of each column: by name, or else by prefix, or else `other`."""
    named = {c: g for g, own in GROUPS.items() for c in own}
    return {c: named.get(c) or next((g for p, g in PREFIXES.items() if c.startswith(p)), "other") for c in columns}
