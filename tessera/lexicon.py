"""The domain vocabulary: configuration that operators take as a parameter.

A lexicon names entities with their aliases (in order), keyword groups, term
groups, category rules over them, weights and thresholds. It is small, checked
when it is read, and goes into plans as constants.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Category:
    """Holds when all groups of ``all_of``, one of ``any_of`` and none of ``none_of`` hold; ``unless`` names a category that takes its place.

    Groups are term groups, or ``entity:<group>`` for any entity of that group.
    """

    name: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    unless: str = ""


#: What a leaf of a rule looks at.
LEAVES = ("terms", "title", "exact", "title_exact", "pattern", "title_pattern", "entity", "name", "source", "quality", "category")


@dataclass(frozen=True)
class Rule:
    """A category that holds when ``when`` does: a leaf, or ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}``, ``{"atleast": n, "of": [...]}`` of such.

    A leaf is ``kind:name``, of terms the name alone: ``terms`` (one of a group in title or summary), ``title`` (in the title), ``exact`` and
    ``title_exact`` (as written), ``pattern`` and ``title_pattern`` (one of the lexicon's patterns), ``entity`` (any of a group), ``name`` (that
    one), ``source`` (the row's source is one of a group of terms), ``quality``, ``category`` (a rule before this one holds).
    """

    name: str
    when: object

    def leaves(self) -> list[tuple[str, str]]:
        found, todo = [], [self.when]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                kind, colon, name = x.partition(":")
                found.append((kind, name) if colon else ("terms", x))
            elif isinstance(x, dict) and set(x) in ({"all"}, {"any"}):
                todo += next(iter(x.values()))
            elif isinstance(x, dict) and set(x) == {"not"}:
                todo.append(x["not"])
            elif isinstance(x, dict) and set(x) == {"atleast", "of"} and type(x["atleast"]) is int:
                todo += x["of"]
            else:
                raise ValueError(f"rule {self.name}: {x!r} is no rule")
        return found


@dataclass(frozen=True)
class Theme:
    name: str
    terms: tuple[str, ...]


# The common words that titles are stripped of before they are compared.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "to", "with")
# Titles that say nothing about an event.
GENERIC_TITLES = ("read more", "learn more", "click here", "view more", "more", "details")
# Points of the additive score.
WEIGHTS = {"high_keyword": 15, "medium_keyword": 7, "context_keyword": 4, "primary_source_bonus": 20, "multiple_entity_bonus": 8, "title_match_bonus": 5, "action_bonus": 20, "institutional_source_bonus": 5, "protocol_bonus": 10, "ledger_bonus": 10}
# Words of incidents, of joint projects and of the regions and money they are about, by which reports of one event are told.
INCIDENT_TERMS = ("hack", "hacked", "exploit", "exploited", "breach", "breached")
EVENT_TERMS = ("cross", "border", "settlement", "stablecoin", "tokenized", "tokenised", "payment", "payments", "custody", "wallet", "ledger", "initiative", "partnership", "digital", "blockchain")
REGION_TERMS = ("singapore", "malaysia", "thailand", "indonesia", "philippines", "vietnam", "cambodia", "laos", "myanmar", "brunei", "brazil", "canada", "mexico", "india", "china", "japan", "korea", "australia", "switzerland", "uae", "saudi", "europe")
FINANCE_TERMS = ("settlement", "stablecoin", "tokenized", "tokenised", "payment", "payments", "digital", "money", "blockchain", "ledger")
# The markers of speculative headlines.
COMMENTARY = (
    "price prediction", "price predictions", "price forecast", "price forecasts", "price outlook", "price target", "price targets", "price analysis", "technical analysis", "chart analysis",
    "analyst predicts", "analysts predict", "analyst expects", "analysts expect", "expert predicts", "experts predict",
    "price could reach", "price could hit", "price may reach", "price might reach", "could reach $", "could hit $", "may reach $", "might reach $", "how high can xrp", "how high will xrp",
)


@dataclass(frozen=True)
class Landing:
    """A page that announces nothing: a title with ``phrase`` and one of ``kinds``, a summary that opens with ``stub`` and names no figure."""

    phrase: str
    kinds: tuple[str, ...]
    stub: str


@dataclass(frozen=True)
class Lexicon:
    #: group -> canonical name -> aliases; the order is that of results
    entities: dict[str, dict[str, tuple[str, ...]]]
    #: group of entities that make a row "direct"
    direct: str
    #: entities whose overlap counts in similarity joins
    high_value: tuple[str, ...]
    #: those for which follow-ups of an incident may lie further apart
    incident_entities: tuple[str, ...] = ()
    incident_terms: tuple[str, ...] = INCIDENT_TERMS
    #: tokens of joint projects, of regions (two of which count), that must all stand for these, and one of which must
    event_terms: tuple[str, ...] = EVENT_TERMS
    region_terms: tuple[str, ...] = REGION_TERMS
    across_terms: tuple[str, ...] = ("cross", "border")
    finance_terms: tuple[str, ...] = FINANCE_TERMS
    #: aliases that count only as they are written
    exact: tuple[str, ...] = ()
    keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    terms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    categories: tuple[Category, ...] = ()
    #: regular expressions by name, and further categories by rules of any form, after the others
    patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    #: categories that make a row topical, and those that earn the action bonus
    topical: tuple[str, ...] = ()
    action: tuple[str, ...] = ()
    commentary: tuple[str, ...] = COMMENTARY
    #: medium keywords that count in a title only, beside a direct entity
    bare: tuple[str, ...] = ()
    #: categories that earn the bonuses of protocol and ledger, that are institutional, and that are if one of ``rail`` stands there too
    protocol: tuple[str, ...] = ()
    ledger: tuple[str, ...] = ()
    institutional: tuple[str, ...] = ()
    by_rail: tuple[str, ...] = ()
    rail: tuple[str, ...] = ()
    landing: Landing | None = None
    themes: tuple[Theme, ...] = ()
    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    publish_score: int = 30

    def __post_init__(self) -> None:
        names = {x for group in self.entities.values() for x in group}
        if unknown := [x for x in (*self.high_value, *self.incident_entities) if x not in names]:
            raise ValueError(f"unknown entities: {unknown}")
        if not 0 <= self.publish_score <= 100 or any(type(x) is not int or x < 0 for x in self.weights.values()):
            raise ValueError("scores lie between 0 and 100, weights are whole and not negative")
        if any(not a.strip() for g in self.entities.values() for aliases in g.values() for a in aliases):
            raise ValueError("an alias is empty")
        kinds = {c.name for c in (*self.categories, *self.rules)}
        if unknown := [x for x in (*self.topical, *self.action, *self.protocol, *self.ledger, *self.institutional, *self.by_rail) if x not in kinds]:
            raise ValueError(f"unknown categories: {unknown}")
        groups = set(self.terms) | {f"entity:{g}" for g in self.entities}
        for c in self.categories:
            if missing := [g for g in (*c.all_of, *c.any_of, *c.none_of) if g not in groups]:
                raise ValueError(f"category {c.name} needs unknown groups {missing}")
        before = {c.name for c in self.categories}
        known = dict.fromkeys(("terms", "title", "exact", "title_exact", "source"), set(self.terms)) | dict.fromkeys(("pattern", "title_pattern"), set(self.patterns)) | {"entity": set(self.entities), "name": names, "quality": {"primary", "high_signal", "discovery"}, "category": before}
        for rule in self.rules:
            if missing := [f"{k}:{n}" for k, n in rule.leaves() if n not in known.get(k, ())]:
                raise ValueError(f"rule {rule.name} needs unknown {missing}")
            before.add(rule.name)

    def ordered(self) -> list[tuple[str, str, tuple[str, ...]]]:
        """(group, canonical name, aliases) in the order of results."""
        return [(g, name, aliases) for g, members in self.entities.items() for name, aliases in members.items()]

    def vocabulary(self) -> tuple[str, ...]:
        """Every term that is looked for in title and summary."""
        named = [a for _, _, aliases in self.ordered() for a in aliases if a not in self.exact]
        themes = [x for theme in self.themes for x in theme.terms]
        return tuple(dict.fromkeys([*named, *self.rail, *themes, *(x for g in (*self.keywords.values(), *self.terms.values()) for x in g)]))

    def title_terms(self) -> tuple[str, ...]:
        kinds = self.landing.kinds if self.landing else ()
        ruled = [x for rule in self.rules for kind, name in rule.leaves() if kind == "title" for x in self.terms[name]]
        return tuple(dict.fromkeys([*kinds, *ruled, *(x for g in self.keywords.values() for x in g)]))

    @classmethod
    def read(cls, text: str) -> "Lexicon":
        """From JSON with the fields above; unknown fields are refused."""
        raw = json.loads(text)
        lists = {k: tuple(raw[k]) for k in ("high_value", "incident_entities", "incident_terms", "event_terms", "region_terms", "across_terms", "finance_terms", "exact", "topical", "action", "commentary", "bare", "protocol", "ledger", "institutional", "by_rail", "rail") if k in raw}
        maps = {k: {n: tuple(v) for n, v in raw[k].items()} for k in ("keywords", "terms", "patterns") if k in raw}
        made = {
            "entities": {g: {n: tuple(a) for n, a in m.items()} for g, m in raw["entities"].items()},
            "categories": tuple(Category(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()}) for c in raw.get("categories", [])),
            "rules": tuple(Rule(r["name"], r["when"]) for r in raw.get("rules", [])),
            "landing": Landing(**raw["landing"] | {"kinds": tuple(raw["landing"]["kinds"])}) if raw.get("landing") else None,
            "themes": tuple(Theme(t["name"], tuple(t["terms"])) for t in raw.get("themes", [])),
        }
        rest = {k: v for k, v in raw.items() if k not in lists and k not in maps and k not in made}
        return cls(**rest, **lists, **maps, **made)


#: A lexicon of words that occur in the synthetic tables, so that queries there find something.
SAMPLE = Lexicon(
    entities={
        "asset": {"Thanea": ("thanea", "anea"), "Eriner": ("eriner",)},
        "company": {"Attion": ("attion", "tionatt"), "Elle": ("elle",), "Keit": ("keit", "heit"), "Une": ("Une",)},
        "authority": {"Thanedble": ("thanedble",), "Nicht": ("nicht", "auch nicht")},
    },
    direct="asset",
    high_value=("Thanea", "Eriner", "Attion", "Elle", "Thanedble", "Keit"),
    incident_entities=("Thanea", "Elle"),
    incident_terms=("thnt", "thre", "ther"),
    keywords={"high": ("thanea", "eriner"), "medium": ("attion", "thnt", "tion"), "context": ("from", "than", "pour")},
    terms={"action": ("thre", "thon", "ment", "thble"), "topic": ("thst", "thth", "this", "une"), "quiet": ("asci",)},
    categories=(
        Category("direct_asset", all_of=("entity:asset",)),
        Category("authority_topic_action", all_of=("entity:authority", "action", "topic")),
        Category("authority_action", all_of=("entity:authority", "action"), unless="authority_topic_action"),
        Category("protocol_change", all_of=("entity:asset",), any_of=("topic",)),
        Category("ledger_note", all_of=("entity:authority", "entity:asset")),
        Category("company_topic", all_of=("entity:company",), any_of=("topic", "action"), none_of=("quiet",)),
    ),
    event_terms=("thanedble", "that", "with", "from", "this", "nicht", "sich"),
    region_terms=("attion", "eriner", "thanea", "elle", "keit", "thnt", "thre", "avec", "pour"),
    across_terms=("that", "from"),
    finance_terms=("tion", "ment", "ther"),
    exact=("Une",),
    bare=("tion",),
    protocol=("protocol_change",),
    ledger=("ledger_note",),
    institutional=("authority_action",),
    by_rail=("company_topic",),
    rail=("avec", "sich", "with", "auch nicht"),
    landing=Landing("the ", ("tion", "thst", "than", "that"), "th"),
    topical=("direct_asset", "authority_topic_action", "authority_action", "company_topic"),
    action=("authority_topic_action", "company_topic"),
    commentary=("thing", "thly"),
    themes=(Theme("adoption", ("thnt", "thre")), Theme("policy", ("thst", "tion")), Theme("custody", ("avec", "sich"))),
)
