"""Constants of the alignment plans; plans take them as literals and never change them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: weights and thresholds of the method
    w_emb: float = 0.40
    w_cov: float = 0.28
    w_lex: float = 0.20
    w_pos: float = 0.12
    cov_contig: float = 0.30
    cov_b_floor: float = 0.75
    cov_b_ref: float = 0.30
    conf_power: int = 3
    conf_margin_ref: float = 0.15
    agg_cov_ok: float = 0.60
    dissens_delta: float = 0.45
    anchor_unique: float = 0.30
    anchor_multi: float = 0.12
    anchor_name_unique: float = 0.20
    anchor_name: float = 0.10
    anchor_cap: float = 0.38
    t_direct: float = 0.60
    t_none: float = 0.44
    near_factor: float = 0.60
    residual_near_distance: int = 2
    residual_min_near: float = 0.10
    residual_min_far: float = 0.22
    residual_max_sources: int = 3
    residual_min_carriers: int = 2
    agg_min_claim_len: int = 55
    redundant_delta: float = 0.07
    split_min_lex: float = 0.16
    question_factor: float = 0.55
    nli_entail_min: float = 0.60
    nli_contra_min: float = 0.55
    nli_contra_margin: float = 0.25
    nli_contra_support_max: float = 0.75
    nli_verbatim_contra: float = 0.90
    nli_verbatim_lex: float = 0.92
    diff_lex_min: float = 0.85
    diff_near_min: float = 0.55
    diff_max_words: int = 5
    diff_max_reports: int = 6
    idf_floor: float = 0.0


CFG = Config()
