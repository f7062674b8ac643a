"""The library's verbs in one place: aggregate, match, build, fit, score, compare, evaluate and publish."""

from scoutframe.operators.aggregate import season_box, season_in_context, shot_profile, team_context
from scoutframe.operators.assembly import build_dataset, consensus_population, engineered, prospect_frame, season_frame
from scoutframe.operators.board import general_board, graded_relevance, overall_score, slot_signal, slot_utility
from scoutframe.operators.bundles import class_payload, season_bundle, supported_seasons, write_documents
from scoutframe.operators.folds import fold_years, logit_folds, out_of_fold, parameters, ridge_folds
from scoutframe.operators.identity import match, season_index
from scoutframe.operators.imports import analysed
from scoutframe.operators.markup import draft_picks, early_entrants, page_blocks, wiki_units
from scoutframe.operators.metrics import board_metrics, fold_report, order_metrics, roc_auc
from scoutframe.operators.need import UnsupportedNeed, check_weights, custom_fit, explained, rank_fit
from scoutframe.operators.parity import differences, summary
from scoutframe.operators.peers import external_percentiles, grids, moments, season_relative
from scoutframe.operators.profiles import Specification, conflicts, evaluated, percentile_frame, position_relative_size
from scoutframe.operators.scoring import Frozen, frozen_fits, pro_pool, scored_class, scored_population, scored_watchlist
from scoutframe.operators.sealed import Tampered, gated_evaluation, seal, unbroken
from scoutframe.operators.similar import eligible_seasons, explained_pairs, farther_share, nearest_of_all, pool, ranked_distances, thresholds
from scoutframe.operators.space import college_space, league_percentiles, league_reference, prepared_pool, pro_space
from scoutframe.sources.incremental import refreshed

__all__ = [
    "Frozen", "Specification", "Tampered", "UnsupportedNeed", "analysed", "board_metrics", "build_dataset", "check_weights", "class_payload",
    "college_space", "conflicts", "consensus_population", "custom_fit", "differences", "draft_picks", "early_entrants", "eligible_seasons", "engineered",
    "evaluated", "explained", "explained_pairs", "external_percentiles", "farther_share", "fold_report", "fold_years", "frozen_fits", "gated_evaluation",
    "general_board", "graded_relevance", "grids", "league_percentiles", "league_reference", "logit_folds", "match", "moments", "nearest_of_all", "order_metrics",
    "out_of_fold", "overall_score", "page_blocks", "parameters", "percentile_frame", "pool", "position_relative_size", "prepared_pool", "pro_pool", "pro_space",
    "prospect_frame", "rank_fit", "ranked_distances", "refreshed", "ridge_folds", "roc_auc", "scored_class", "scored_population", "scored_watchlist", "seal",
    "season_box", "season_bundle", "season_frame", "season_in_context", "season_index", "season_relative", "shot_profile", "slot_signal", "slot_utility",
    "summary", "supported_seasons", "team_context", "thresholds", "unbroken", "wiki_units", "write_documents",
]
