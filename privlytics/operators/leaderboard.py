"""Leaderboards: governance markers, grouping, pivots, upserts, model cards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLEAN, OVERLAP, UNKNOWN = "clean_held_out", "in_distribution", "unknown"
#: Tracks that no model was trained on, real annotated gold, adapters trained on none of the data, adapters trained on
#: the general tracks' source, those tracks, and the prefix and suffix of that source's open tracks.
REAL_GOLD = ("tab-echr-legal-en-v1",)
CLEAN_CONFIGS = ("ro-realskeleton-v1", "pl-realskeleton-v1", "it-realskeleton-v1", "legal-realskeleton-v1", *REAL_GOLD)
RULE_BASED = ("presidio", "spacy", "gliner2")
SOURCE_TRAINED = ("openmed", "tabularisai")
SOURCE_CONFIGS = ("en", "de", "fr", "it", "es", "nl")
OPEN_PREFIX, OPEN_SUFFIX = "ai4privacy-openpii-", "-v1"
#: What an own model was trained on.
OWN_OVERLAP = ("ro-synthetic-v1",)
OWN_LANGUAGES = ("ro", "en")
#: Fields that a model card must fill in.
CARD_FIELDS = ("hf_model_id", "adapter", "intended_use", "training_data", "languages", "domains", "known_limitations", "contamination_statement")


def contamination(adapter: Column, config: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether an adapter's model may have seen a track; ``own`` names the adapters of the own model. First fitting rule wins."""
    is_open = config.startswith(OPEN_PREFIX) & config.endswith(OPEN_SUFFIX)
    lang = F.substr(config, F.lit(len(OPEN_PREFIX) + 1), F.length(config) - len(OPEN_PREFIX) - len(OPEN_SUFFIX))
    mine, trained = adapter.isin(*own) if own else F.lit(False), adapter.isin(*SOURCE_TRAINED)
    zero_shot = [c for c in SOURCE_CONFIGS if c not in OWN_LANGUAGES]
    return (
        F.when(config.isin(*CLEAN_CONFIGS) | adapter.isin(*RULE_BASED), CLEAN)
        .when(is_open & trained, OVERLAP)
        .when(is_open & mine, F.when(lang.isin(*OWN_LANGUAGES), UNKNOWN).otherwise(CLEAN))
        .when(trained & config.isin(*SOURCE_CONFIGS), OVERLAP)
        .when(mine & config.isin(*OWN_OVERLAP), OVERLAP)
        .when(mine & config.isin(*zero_shot), CLEAN)
        .otherwise(UNKNOWN)
    )


def config_status(config: Column) -> Column:
    return F.when(config.isin(*REAL_GOLD), "real-external-gold").otherwise("dev")


def annotate(rows: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """Rows (adapter, config, ..) with ``contamination`` and ``config_status``, set only where they are not there yet."""
    fresh = {"contamination": contamination(F.col("adapter"), F.col("config"), own), "config_status": config_status(F.col("config"))}
    return rows.withColumns({k: F.coalesce(k, v) if k in rows.columns else v for k, v in fresh.items()})


def build(rows: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """(entry, specs): annotated rows of each ``adapter::model_id``, by spec. A board has as many rows as models x specs."""
    entry = F.concat(F.coalesce("adapter", F.lit("?")), F.lit("::"), F.coalesce("model_id", F.lit("?")))
    cells = annotate(rows, own)
    rest = [c for c in cells.columns if c not in ("adapter", "model_id", "spec")]
    return cells.groupBy(entry.alias("entry")).agg(F.array_sort(F.collect_list(F.struct("spec", *rest))).alias("specs"))


def upsert(board: DataFrame, fresh: DataFrame, config: str) -> DataFrame:
    """The board without rows of ``config``, and the fresh rows."""
    return board.filter(~F.col("config").eqNullSafe(config)).unionByName(fresh, allowMissingColumns=True)


def score_pivot(rows: DataFrame, adapters: list[str]) -> DataFrame:
    """(spec, one column for each adapter): ``f1/f2`` to three digits, ``-`` where unknown; of an adapter's models the last id counts, of its rows the last cell."""
    cell = F.when(F.col("f1").isNotNull() & F.col("f2").isNotNull(), F.format_string("%.3f/%.3f", F.col("f1"), F.col("f2"))).otherwise("-")
    wide = rows.groupBy("spec").pivot("adapter", adapters).agg(F.max(F.struct(F.coalesce("model_id", F.lit("")).alias("m"), cell.alias("c"))))
    return wide.select("spec", *(F.coalesce(F.col(f"`{a}`")["c"], F.lit("-")).alias(a) for a in adapters))


def leak_rows(rows: DataFrame) -> DataFrame:
    """(spec, adapter, leak_rate, missed, leaked_qi) of rows that have a leak score, by its present or its old name."""
    old = [c for c in ("cnp_leak_rate", "cnp_missed") if c in rows.columns]
    rate = F.coalesce("leak_rate", *(["cnp_leak_rate"] if "cnp_leak_rate" in old else []))
    missed = F.coalesce("missed", *(["cnp_missed"] if "cnp_missed" in old else []), F.lit(0))
    return rows.select("spec", "adapter", rate.alias("leak_rate"), missed.alias("missed"), "leaked_qi").filter("leak_rate is not null")


def track_points(rows: DataFrame, config: str) -> DataFrame:
    """(adapter, f1, leak_rate, missed) of one track's rows."""
    found = rows.filter(F.col("config") == config)
    return leak_rows(found.withColumn("spec", F.struct("spec", "f1"))).select("adapter", "spec.f1", "leak_rate", "missed")


def ranked(points: DataFrame) -> DataFrame:
    """Points with their place in ascending f1, ties by adapter."""
    return points.withColumn("place", F.row_number().over(Window.orderBy("f1", "adapter")))


def validate_card(card: Mapping, adapters: tuple[str, ...]) -> Mapping:
    """The card, if every field is filled in, the adapter is known and the model is pinned to a version; else ValueError."""
    if not isinstance(card, Mapping):
        raise ValueError("a model card is a mapping")
    missing = [f for f in CARD_FIELDS if not card.get(f)]
    if missing:
        raise ValueError(f"model card without {', '.join(missing)}")
    if card["adapter"] not in adapters:
        raise ValueError(f"unknown adapter {card['adapter']!r}")
    if "@" not in str(card["hf_model_id"]):
        raise ValueError("hf_model_id names no version (name@version)")
    return card


def board_text(board: Mapping) -> str:
    """A written board as two plain tables: F1 and F2 by spec and adapter, then leak rates, missed ids and what they give away."""
    cells = {(row["spec"], entry.split("::", 1)[0]): row for entry, rows in board.get("entries", {}).items() for row in rows}
    specs, adapters = (sorted({key[i] for key in cells}) for i in (0, 1))
    scored = lambda row: f"{row['f1']:.3f}/{row['f2']:.3f}" if row and row.get("f1") is not None and row.get("f2") is not None else "-"
    lines = [["spec", *adapters], *([s, *(scored(cells.get((s, a))) for a in adapters)] for s in specs)]
    first = lambda row, *names: next((row[n] for n in names if row.get(n) is not None), None)
    leaks = [(s, a, first(cells[s, a], "leak_rate", "cnp_leak_rate"), cells[s, a]) for s in specs for a in adapters if (s, a) in cells]
    told = [[s, a, f"{rate:.3f}", str(first(row, "missed", "cnp_missed") or 0), str(first(row, "leaked_qi") or 0)] for s, a, rate, row in leaks if rate is not None]
    tables = [lines, [["spec", "adapter", "leak_rate", "missed", "leaked_qi"], *told]] if told else [lines]
    width = lambda table: [max(len(r[i]) for r in table) for i in range(len(table[0]))]
    return "\n\n".join("\n".join("  ".join(c.ljust(w) for c, w in zip(row, width(t), strict=True)).rstrip() for row in t) for t in tables)
