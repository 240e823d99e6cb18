"""Entities, categories and the additive score, as expressions over one scan.

A text is folded and split into words once; all terms of the lexicon that it holds
are one short array, against which entities, term groups and keywords are tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.lexicon import Lexicon

BANDS = (("0-14", 0, 14), ("15-29", 15, 29), ("30-49", 30, 49), ("50-69", 50, 69), ("70-100", 70, 100))


HITS, TITLE_HITS = "_hits", "_title_hits"
# Fixed value: a figure that a report names.
FIGURE = r"(?i)([$€£]\s*\d|(^|[^\p{L}\p{N}_])\d+([.,]\d+)?\s*(%|(million|billion|thousand|m|b)($|[^\p{L}\p{N}_])))"


def with_hits(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The terms of the lexicon in title and summary, and those in the title, as hidden columns for what follows."""
    if HITS in items.columns:
        return items
    both = F.concat_ws(" ", "title", "summary")
    made = items.withColumns({"_folded": t.folded(both), "_folded_title": t.folded(F.coalesce("title", F.lit("")))})
    return made.withColumns({HITS: t.term_hits(F.col("_folded"), lexicon.vocabulary()), TITLE_HITS: t.term_hits(F.col("_folded_title"), lexicon.title_terms())}).drop("_folded", "_folded_title")


def hit(terms: tuple[str, ...], column: str = HITS) -> F.Column:
    return F.arrays_overlap(column, t.listed(list(map(t.fold, terms)))) if terms else F.lit(False)


def _entities(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    both = F.concat_ws(" ", "title", "summary")
    found = []
    for _, name, aliases in lexicon.ordered():
        exact = [both.contains(a) & both.rlike(t.phrase_pattern((a,)).removeprefix("(?i)")) for a in aliases if a in lexicon.exact]
        found.append(F.when(t.any_of([hit(tuple(a for a in aliases if a not in lexicon.exact)), *exact]), F.lit(name)))
    return items.withColumn("entities", F.array_compact(F.array(*found)))


def with_entities(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``entities``: the names found in title and summary, in the lexicon's order. Hidden hits stay where they were there before."""
    found = _entities(with_hits(items, lexicon), lexicon)
    return found if HITS in items.columns else found.drop(HITS, TITLE_HITS)


def _categories(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    column = {g: hit(terms) for g, terms in lexicon.terms.items()}
    column |= {f"entity:{g}": F.arrays_overlap("entities", t.listed(list(members))) for g, members in lexicon.entities.items()}
    held: dict[str, F.Column] = {}
    for c in lexicon.categories:
        rule = t.all_of([column[g] for g in c.all_of])
        if c.any_of:
            rule = rule & t.any_of([column[g] for g in c.any_of])
        if c.none_of:
            rule = rule & ~t.any_of([column[g] for g in c.none_of])
        held[c.name] = rule & ~held[c.unless] if c.unless else rule
    for r in lexicon.rules:
        held[r.name] = F.coalesce(_ruled(r.when, lexicon, held), F.lit(False))
    return items.withColumn("categories", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in held.items()])))


def _leaf(kind: str, name: str, lexicon: Lexicon, held: dict[str, F.Column]) -> F.Column:
    both, title = F.concat_ws(" ", "title", "summary"), F.coalesce("title", F.lit(""))
    if kind in ("exact", "title_exact"):
        text = title if kind == "title_exact" else both
        return t.any_of([text.contains(x) & text.rlike(t.phrase_pattern((x,)).removeprefix("(?i)")) for x in lexicon.terms[name]])
    if kind in ("pattern", "title_pattern"):
        return t.any_of([(title if kind == "title_pattern" else both).rlike(x) for x in lexicon.patterns[name]])
    if kind == "entity":
        return F.arrays_overlap("entities", t.listed(list(lexicon.entities[name])))
    if kind == "name":
        return F.array_contains("entities", name)
    if kind == "source":
        return F.col("source_id").isin(*lexicon.terms[name])
    if kind == "quality":
        return F.col("quality") == name
    return held[name] if kind == "category" else hit(lexicon.terms[name], TITLE_HITS if kind == "title" else HITS)


def _ruled(when: object, lexicon: Lexicon, held: dict[str, F.Column]) -> F.Column:
    """A rule as one expression; what a row lacks (a source, a title) makes a leaf false."""
    if isinstance(when, str):
        kind, colon, name = when.partition(":")
        return F.coalesce(_leaf(kind, name, lexicon, held) if colon else _leaf("terms", when, lexicon, held), F.lit(False))
    if "not" in when:
        return ~_ruled(when["not"], lexicon, held)
    if "all" in when:
        return t.all_of([_ruled(x, lexicon, held) for x in when["all"]])
    parts = [_ruled(x, lexicon, held) for x in when.get("any", when.get("of"))]
    return t.any_of(parts) if "any" in when else sum((x.cast("int") for x in parts), F.lit(0)) >= when["atleast"]


def with_categories(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``categories`` in the lexicon's order, by its rules over term and entity groups; needs ``entities``."""
    return _categories(with_hits(items, lexicon), lexicon).drop(HITS, TITLE_HITS)


def is_landing(lexicon: Lexicon) -> F.Column:
    """Whether a row is a landing page that announces nothing (needs hidden hits)."""
    rule = lexicon.landing
    if rule is None:
        return F.lit(False)
    title, summary = F.lower(F.coalesce("title", F.lit(""))), F.coalesce("summary", F.lit(""))
    return title.contains(rule.phrase.lower()) & hit(rule.kinds, TITLE_HITS) & F.ltrim(F.lower(summary)).startswith(rule.stub) & ~summary.rlike(FIGURE)


def _score(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    w, words = lexicon.weights, lexicon.keywords
    any_category = lambda names: F.arrays_overlap("categories", t.listed(list(names)))
    marked = items.withColumns({
        "_landing": F.coalesce(is_landing(lexicon), F.lit(False)),
        "_direct": F.arrays_overlap("entities", t.listed(list(lexicon.entities[lexicon.direct]))),
        "_institutional": any_category(lexicon.institutional) | (any_category(lexicon.by_rail) & hit(lexicon.rail)),
    }).withColumn("_topical", F.col("_direct") | F.col("_institutional") | any_category(lexicon.topical))
    direct, topical, primary = F.col("_direct"), F.col("_topical"), F.col("quality") == "primary"
    every = tuple(dict.fromkeys(x for group in words.values() for x in group))
    plain = tuple(x for x in every if x not in lexicon.bare)
    signals = {
        "high_keyword": direct & hit(words.get("high", ())),
        "medium_keyword": topical & hit(tuple(x for x in words.get("medium", ()) if x not in lexicon.bare)),
        "context_keyword": topical & hit(words.get("context", ())),
        "protocol_bonus": any_category(lexicon.protocol),
        "ledger_bonus": any_category(lexicon.ledger),
        "action_bonus": any_category(lexicon.action),
        "primary_source_bonus": topical & primary,
        "institutional_source_bonus": F.col("_institutional") & primary,
        "multiple_entity_bonus": direct & (F.size("entities") > 1),
        "title_match_bonus": topical & (hit(plain, TITLE_HITS) | (direct & hit(every, TITLE_HITS))),
    }
    marked = marked.withColumns({f"_s_{k}": ~F.col("_landing") & F.coalesce(v, F.lit(False)) for k, v in signals.items()})
    points = sum((F.when(F.col(f"_s_{k}"), w[k]).otherwise(0) for k in signals), F.lit(0))
    reasons = F.array_compact(F.array(F.when(F.col("_landing"), F.lit("landing page")), *[F.when(F.col(f"_s_{k}"), F.lit(f"{k} (+{w[k]})")) for k in signals]))
    marked = marked.withColumns({"score": F.least(F.lit(100), points).cast("int"), "reasons": reasons, "categories": F.when(F.col("_landing"), t.listed([])).otherwise(F.col("categories"))})
    return marked.drop("_landing", "_direct", "_institutional", "_topical", *[f"_s_{k}" for k in signals])


def with_score(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``score`` (0 to 100) and ``reasons``: each signal adds its points once; a landing page has score 0 and no category. Needs ``entities`` and ``categories``."""
    return _score(with_hits(items, lexicon), lexicon).drop(HITS, TITLE_HITS)


def scored(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    return _score(_categories(_entities(with_hits(items, lexicon), lexicon), lexicon), lexicon).drop(HITS, TITLE_HITS)


def band(score: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for name, low, high in BANDS:
        out = F.when((score >= low) & (score <= high), name).otherwise(out)
    return out


def histogram(items: DataFrame) -> DataFrame:
    """How many rows lie in each band; bands without rows count 0."""
    # zeros are added by a union: a join's inferred filters would be pushed down and repeat the score's whole expression
    per_score = items.groupBy("score").agg(F.count("*").alias("n"))
    zeros = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n, _, _ in BANDS])).alias("band"), F.lit(0).cast("bigint").alias("n"))
    return per_score.select(band(F.col("score")).alias("band"), "n").unionByName(zeros).groupBy("band").agg(F.sum("n").alias("n_items"))


def source_yield(items: DataFrame, gate: int) -> DataFrame:
    key = F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.lit("unknown-source"))
    return items.groupBy(key.alias("source_key")).agg(F.count("*").alias("observed"), F.count_if(F.col("score") >= gate).alias("qualifying"), F.max("score").alias("best"), F.count_if(F.col("quality") == "primary").alias("n_primary"))


def is_commentary(lexicon: Lexicon) -> F.Column:
    """Speculative headlines of second-tier sources."""
    return (F.col("quality") == "high_signal") & F.lower("title").rlike("|".join(t.literal(t.fold(m)) for m in lexicon.commentary))


def top(items: DataFrame, k: int, gate: int = 0) -> DataFrame:
    """The k best, ties to the later, then by title, then by id; they come oldest first."""
    return items.where(F.col("score") >= gate).orderBy(F.desc("score"), F.desc("published_at"), F.lower("title"), "item_id").limit(k).orderBy("published_at", "item_id")


def audit(items: DataFrame, k: int) -> DataFrame:
    """The k best with their ``rank``, ties by title and then id: what a report of a run shows of all that it saw."""
    best = items.orderBy(F.desc("score"), F.lower("title"), "item_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.lower("title"), "item_id")))
