"""Pipelines from properties, and prediction from raw text to typed spans and relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import mentions as M
from spanloom.operators import metrics
from spanloom.operators import pairs as P
from spanloom.operators import rewrite as R
from spanloom.operators import segment as G
from spanloom.operators.features import relation_categories

Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]

#: Slots in the order they run, each with its algorithms by name.
SLOTS: dict[str, dict[str, Callable[..., Step]]] = {"tagger_parser": {}, "ner": {}, "vectorizers": {}, "entities_collapser": {}, "ne_collapser": {}}


def register(slot: str, name: str):
    """Add an algorithm, a function from its properties to a step over a document's tables."""

    def add(make: Callable[..., Step]) -> Callable[..., Step]:
        SLOTS[slot][name] = make
        return make

    return add


@register("ner", "rules")
def _rules(**_: object) -> Step:
    return lambda t: t | {"ne": M.rule_mentions(t["tokens"])}


@register("entities_collapser", "types")
def _collapse(types: list[str], layer: str = "mentions") -> Step:
    """Mentions of these types become one token each, and with them all features of tokens and the bounds of all layers."""
    return lambda t: R.collapse(t, types, layer)


@register("ne_collapser", "types")
def _collapse_ne(types: list[str]) -> Step:
    return _collapse(types, "ne")


def from_properties(properties: dict[str, dict]) -> Step:
    """The steps of all slots that are named, in the slots' order; each slot has exactly one algorithm."""
    steps = []
    for slot, algorithms in SLOTS.items():
        chosen = properties.get(slot)
        if chosen is None:
            continue
        if len(chosen) != 1:
            raise ValueError(f"{slot} needs exactly one algorithm")
        ((name, options),) = chosen.items()
        steps.append(algorithms[name](**options))
    if unknown := properties.keys() - SLOTS.keys():
        raise KeyError(f"no such slot: {sorted(unknown)}")

    def run(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for step in steps:
            tables = step(tables)
        return tables

    return run


def predict(docs: DataFrame, mentions: Callable[[DataFrame], DataFrame] = M.rule_mentions, relate: Callable[[DataFrame], DataFrame] | None = None, raw_entities: DataFrame | None = None, near: int | None = None) -> dict[str, DataFrame]:
    """From (doc_id, text) to entities in characters, numbered T1, T2, ..., and relations between them.

    Given raw entities are aligned with the tokens in place of found ones. ``relate`` labels candidate pairs, those of a
    sentence, and with ``near`` those within so many tokens, which alone meet then.
    """
    tokens = G.tokens(docs)
    if raw_entities is None:
        found = mentions(tokens)
    else:
        aligned = M.align_raw(raw_entities, tokens).where("start_token IS NOT NULL")
        found = M.numbered(M.sentence_of(aligned.select("doc_id", "start_token", "end_token", "type"), tokens))
    first = tokens.select("doc_id", F.col("tok_idx").alias("start_token"), "char_start")
    last = tokens.select("doc_id", (F.col("tok_idx") + 1).alias("end_token"), "char_end")
    entities = found.join(first, ["doc_id", "start_token"]).join(last, ["doc_id", "end_token"]).select("doc_id", F.col("ent_id").alias("id"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), "type")
    if relate is None:
        return {"tokens": tokens, "entities": entities}
    labelled = relate(P.candidates(found, P.different(), in_sentence=True, near=near)).where("label IS NOT NULL")
    return {"tokens": tokens, "entities": entities, "relations": labelled.select("doc_id", F.col("e1.ent_id").alias("first"), F.col("e2.ent_id").alias("second"), F.col("label").alias("type"))}


def checked_entities(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """Raw entities that don't lie within their text: none must come out."""
    return raw.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id", "left").where(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.coalesce("n", F.lit(-1)))))


def evaluate(predicted: DataFrame, gold: DataFrame, keys: list[str], docs: DataFrame, categories: dict[str, str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Micro, macro and categorised scores of one task; ``prepare`` adds the columns of categories that items lack."""
    found = metrics.outcome(predicted, gold, keys)
    found = prepare(found) if prepare else found
    return {"micro": metrics.micro(found), "macro": metrics.macro(found, docs), "categories": metrics.categorized(found, categories)}


#: Keys and categories of the tasks that have an evaluator.
EVALUATORS = {
    "ner": (["doc_id", "start_token", "end_token", "type"], {"type": "type"}),
    "net": (["doc_id", "start_token", "end_token", "type"], {"type": "type"}),
    "rel_ext": (["doc_id", "e1", "e2", "rel_type"], {"type": "rel_type"} | {c: c for c in ("args_types", "args_token_log_dists", "args_sent_dists")}, relation_categories),
}


def evaluator_for(task: str) -> Callable[[DataFrame, DataFrame, DataFrame], dict[str, DataFrame]]:
    keys, categories, *prepare = EVALUATORS[task]
    return lambda predicted, gold, docs: evaluate(predicted, gold, keys, docs, categories, *prepare)


def difference(base: dict, other: dict) -> dict:
    """What ``other`` has that ``base`` has not, or has otherwise; nested dictionaries are compared inside."""
    out = {}
    for key, value in other.items():
        old = base.get(key)
        if isinstance(old, dict) and isinstance(value, dict):
            if old != value:
                out[key] = difference(old, value)
        elif old is None or old != value:
            out[key] = value
    return out


def without_paths(properties: dict, paths: list[list[str]]) -> dict:
    """Properties without the entries at these paths of keys."""
    firsts = {path[0] for path in paths if len(path) == 1}
    kept = {}
    for key, value in properties.items():
        deeper = [path[1:] for path in paths if len(path) > 1 and path[0] == key]
        if key not in firsts:
            kept[key] = without_paths(value, deeper) if deeper and isinstance(value, dict) else value
    return kept


#: For each task that has preprocessing, its layers of mentions with the property that says how their types merge.
PREPROCESSED = {"ner": {"mentions": "ent_types_merge_pattern"}, "net": {"mentions": "ent_types_merge_pattern", "ne": "ne_types_merge_pattern"}}


def preprocessor_for(task: str, properties: dict) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """The function from a document model to the one that a task learns from: mentions of some types left out, types
    merged in each layer by its own pattern, and no relations. The layer ``ne`` is made of the same mentions."""
    if task not in PREPROCESSED:
        raise KeyError(f"there is no preprocessing for {task}")
    dropped = list(properties.get("ent_types_to_filter", []))
    merged = {layer: M.merge_pattern(properties.get(pattern, {})) for layer, pattern in PREPROCESSED[task].items()}

    def process(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        layers = {layer: M.filter_types(parts["mentions"], dropped, renamed) for layer, renamed in merged.items()}
        return {k: v for k, v in parts.items() if k != "relations"} | layers

    return process
