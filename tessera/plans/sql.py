"""The queries in DuckDB's SQL, over the same tables, for comparison.

Lists of terms come from the sample lexicon; the rules are written out here.
"""

from __future__ import annotations

from tessera.functions import text
from tessera.functions.text import phrase_pattern
from tessera.lexicon import GENERIC_TITLES, SAMPLE, STOPWORDS, Category
from tessera.operators import grounding
from tessera.operators.items import START

NOW, HISTORY = START + 24 * 86400, START + 10 * 86400
GATE = SAMPLE.publish_score


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _has(of: str, terms) -> str:
    return f"regexp_matches({of}, '{phrase_pattern(tuple(terms))}')"


def _case(rule: str, value: str) -> str:
    return f"CASE WHEN {rule} THEN '{value}' END"


def _compact(cases) -> str:
    return "list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)"


BOTH = "(title || ' ' || summary)"


def _folded(x: str) -> str:
    """NFKC and case folding of the letters that the tables have."""
    return f"replace(lower({x}), 'ß', 'ss')"


def _words(x: str) -> str:
    return f"regexp_extract_all({_folded(x)}, '[a-z0-9]+')"


WORDS = _words("title")
ITEMS = f"""items AS (SELECT *, CASE tier WHEN 1 THEN 'primary' WHEN 2 THEN 'high_signal' ELSE 'discovery' END AS quality,
  strftime(make_timestamp(tm * 1000000), '%Y-%m-%d') AS day FROM (
  SELECT CAST(doc_id AS BIGINT) AS item_id, split_part(coalesce(text, ''), chr(10), 1) AS title,
  substring(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS summary, source AS source_id,
  'https://' || coalesce(source, 'none') || '.example/' || doc_id AS url, 1 + coalesce(TRY_CAST(substring(source, 4) AS INT), 2) % 3 AS tier,
  {START} + doc_id % 30 * 86400 + doc_id % 1440 * 60 AS tm FROM documents))"""
KEYS = f"""{ITEMS}, keyed AS (SELECT *, sha256(lower(trim(url)) || '|' || lower(trim(title))) AS fingerprint, {WORDS} AS w FROM items),
keys AS (SELECT *, CASE WHEN len(w) < 4 OR length(array_to_string(w, '')) < 20 THEN fingerprint ELSE sha256('headline|' || day || '|' || array_to_string(w, ' ')) END AS event_key FROM keyed)"""


def _named(aliases) -> str:
    """Any alias, those that count as written with their case."""
    plain, exact = [a for a in aliases if a not in SAMPLE.exact], [a for a in aliases if a in SAMPLE.exact]
    return " OR ".join([_has(BOTH, plain)] * bool(plain) + [f"regexp_matches({BOTH}, '{phrase_pattern(tuple(exact)).removeprefix('(?i)')}')"] * bool(exact))


ENTITIES = f"{ITEMS}, named AS (SELECT *, {_compact(_case(_named(aliases), name) for _, name, aliases in SAMPLE.ordered())} AS entities FROM items)"


def _group(g: str) -> str:
    kind, _, which = g.partition(":")
    return f"list_has_any(entities, {_list(SAMPLE.entities[which])})" if which else _has(BOTH, SAMPLE.terms[g])


def _rule(c: Category) -> str:
    parts = [_group(g) for g in c.all_of]
    if c.any_of:
        parts.append("(" + " OR ".join(_group(g) for g in c.any_of) + ")")
    parts += [f"NOT {_group(g)}" for g in c.none_of]
    if c.unless:
        parts.append(f"NOT ({_rule(next(x for x in SAMPLE.categories if x.name == c.unless))})")
    return " AND ".join(parts)


_W, _K = SAMPLE.weights, SAMPLE.keywords
_DIRECT = f"list_has_any(entities, {_list(SAMPLE.entities[SAMPLE.direct])})"
_ALL = tuple(dict.fromkeys(x for g in _K.values() for x in g))


def _any_category(names) -> str:
    return f"list_has_any(rules, {_list(names)})"


_INSTITUTIONAL = f"({_any_category(SAMPLE.institutional)} OR ({_any_category(SAMPLE.by_rail)} AND {_has(BOTH, SAMPLE.rail)}))"
_TOPICAL = f"({_DIRECT} OR {_INSTITUTIONAL} OR {_any_category(SAMPLE.topical)})"
_LANDING = f"""(contains(lower(title), '{SAMPLE.landing.phrase}') AND {_has('title', SAMPLE.landing.kinds)} AND starts_with(ltrim(lower(summary)), '{SAMPLE.landing.stub}')
  AND NOT regexp_matches(summary, '(?i)([$€£]\\s*\\d|(^|[^\\p{{L}}\\p{{N}}_])\\d+([.,]\\d+)?\\s*(%|(million|billion|thousand|m|b)($|[^\\p{{L}}\\p{{N}}_])))'))"""
_SIGNALS = {
    "high_keyword": f"{_DIRECT} AND {_has(BOTH, _K['high'])}",
    "medium_keyword": f"{_TOPICAL} AND {_has(BOTH, [x for x in _K['medium'] if x not in SAMPLE.bare])}",
    "context_keyword": f"{_TOPICAL} AND {_has(BOTH, _K['context'])}",
    "protocol_bonus": _any_category(SAMPLE.protocol),
    "ledger_bonus": _any_category(SAMPLE.ledger),
    "action_bonus": _any_category(SAMPLE.action),
    "primary_source_bonus": f"{_TOPICAL} AND quality = 'primary'",
    "institutional_source_bonus": f"{_INSTITUTIONAL} AND quality = 'primary'",
    "multiple_entity_bonus": f"{_DIRECT} AND len(entities) > 1",
    "title_match_bonus": f"{_TOPICAL} AND ({_has('title', [x for x in _ALL if x not in SAMPLE.bare])} OR ({_DIRECT} AND {_has('title', _ALL)}))",
}
SCORED = f"""{ENTITIES}, classed AS (SELECT *, {_compact(_case(_rule(c), c.name) for c in SAMPLE.categories)} AS rules, {_LANDING} AS landing FROM named),
scored AS (SELECT *, CASE WHEN landing THEN [] ELSE rules END AS categories, CASE WHEN landing THEN 0 ELSE CAST(least(100, {' + '.join(f'CASE WHEN {s} THEN {_W[k]} ELSE 0 END' for k, s in _SIGNALS.items())}) AS INT) END AS score,
  CASE WHEN landing THEN ['landing page'] ELSE {_compact(_case(s, f'{k} (+{_W[k]})') for k, s in _SIGNALS.items())} END AS reasons FROM classed)"""
_BAND = "CASE WHEN score <= 14 THEN '0-14' WHEN score <= 29 THEN '15-29' WHEN score <= 49 THEN '30-49' WHEN score <= 69 THEN '50-69' ELSE '70-100' END"
#: Tokens and high-value entities. No title of the tables names an amount, so the join leaves out follow-ups of incidents; tests cover them.
CARDS = f"""{SCORED}, cards AS MATERIALIZED (SELECT item_id, source_id, quality, score, tm, CAST(day AS DATE) AS day,
  list_sort(list_filter(list_distinct({WORDS}), lambda x: NOT list_contains({_list(STOPWORDS)}, x) AND (length(x) > 2 OR regexp_matches(x, '^[0-9]+$')))) AS tokens,
  list_filter(entities, lambda x: list_contains({_list(SAMPLE.high_value)}, x)) AS high FROM scored),
card AS MATERIALIZED (SELECT * FROM cards WHERE len(tokens) > 0 AND len(high) > 0)"""


def _pairs(left: str, right: str) -> str:
    return f"""near AS (SELECT l.item_id AS a, r.item_id AS b, l.source_id AS source_a, r.source_id AS source_b, abs(date_diff('day', l.day, r.day)) AS gap,
  len(list_intersect(l.tokens, r.tokens)) / (len(l.tokens) + len(r.tokens) - len(list_intersect(l.tokens, r.tokens))) AS jac, list_intersect(l.high, r.high) AS shared,
  r.score AS score_b FROM {left} l JOIN {right} r ON abs(date_diff('day', l.day, r.day)) <= 1 AND l.item_id <> r.item_id AND l.source_id <> r.source_id
  WHERE list_has_any(l.high, r.high) AND len(list_intersect(l.tokens, r.tokens)) >= 2),
pairs AS (SELECT *, 60 + CASE WHEN gap = 0 THEN 15 ELSE 0 END + CASE WHEN jac >= 0.45 THEN 15 ELSE 0 END AS points FROM near WHERE jac >= 0.30)"""


_ROLL = """rolled AS (SELECT a AS item_id, max(points) AS correlation_score, array_to_string(list_sort(list(DISTINCT source_b)), ',') AS sources, count(DISTINCT b) AS n_linked,
  array_to_string(list_sort(list_distinct(flatten(list(shared)))), ',') AS shared_entities FROM pairs GROUP BY a)"""
_ROLLED = "SELECT item_id, CAST(correlation_score AS INT) AS correlation_score, sources, n_linked, shared_entities FROM rolled"
_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'partial' ELSE 'success' END"
_STREAKS = f"""WITH a AS (SELECT event_id, user_id, ts, {_STATUS} AS status FROM events),
b AS (SELECT *, lag(status) OVER w AS was, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER w AS f, sum(CASE WHEN status IN ('empty', 'partial') THEN 0 ELSE 1 END) OVER w AS e FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(CASE WHEN status <> 'success' AND status = was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM b),
d AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, f ORDER BY ts, event_id) AS nf,
  sum(CASE WHEN status IN ('empty', 'partial') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, e ORDER BY ts, event_id) AS ne, min(ts) OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS began FROM c)"""
_HALVES = f"""WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM events),
l AS (SELECT late, user_id, max_by(struct_pack(event_id, event_type, value), struct_pack(ts, event_id)) AS l FROM e GROUP BY 1, 2),
old AS (SELECT user_id, l.event_id, l.event_type, l.value FROM l WHERE NOT late), new AS (SELECT user_id, l.event_id, l.event_type, l.value FROM l WHERE late)"""
_THEMES = _compact(_case(_has(BOTH, th.terms), th.name) for th in SAMPLE.themes)
_NORM = "array_to_string(regexp_extract_all(replace(regexp_replace(lower({x}), 'https?://[^ \\t\\n\\r\\f]+', ' ', 'g'), 'ß', 'ss'), '[a-z0-9]+'), ' ')"
_ACTION = rf"(?is)(.*?)\b({text._NEGATIVE})\b"
#: Items with a clause that states such an action, neither denied nor speculated about.
STATED = rf"""clauses AS (SELECT item_id, unnest(regexp_split_to_array({BOTH}, '[.!?;]\s+|,\s+|(?i:\bbut\b|\bhowever\b)')) AS clause FROM items),
actions AS (SELECT item_id, regexp_extract_all(clause, '{_ACTION}', 1) AS b, regexp_extract_all(clause, '{_ACTION}', 2) AS w FROM clauses),
each_action AS (SELECT item_id, array_to_string(list_transform(range(1, k), lambda i: b[i] || w[i]), '') || b[k] AS before, w[k] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM actions)),
stated AS (SELECT DISTINCT item_id FROM each_action WHERE NOT regexp_matches(right(before, 120), '(?i)\b({text._SPECULATION})\b')
  AND NOT regexp_matches(right(before, 80) || word, '(?i)\b({text._DENIAL})\s+(yet\s+)?(being\s+|been\s+|be\s+)?({text._NEGATIVE})\b'))"""
_SQUEEZE = "trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_ESCAPE = "regexp_replace({x}, '([\\\\*_`~|>\\[\\]()@])', '\\\\\\1', 'g')"


def _clip(x: str, n: int) -> str:
    line = _SQUEEZE.format(x=_ESCAPE.format(x=x))
    return f"CASE WHEN length({line}) <= {n} THEN {line} ELSE rtrim(substring({line}, 1, {n - 1})) || '…' END"


def _theses(where: str = "true") -> str:
    return f"""WITH {ENTITIES}, {STATED}, h AS (SELECT item_id, title, source_id, quality, entities, unnest({_THEMES}) AS theme FROM named WHERE {where}), x AS (SELECT theme, unnest(entities) AS entity, title, source_id, quality, item_id FROM h),
      t AS (SELECT doc_id, max(toxic) = 1 AS bad FROM labels GROUP BY 1), y AS (SELECT x.*, coalesce(bad, false) OR item_id IN (SELECT item_id FROM stated) AS bad FROM x LEFT JOIN t ON t.doc_id = item_id),
      g AS (SELECT theme, entity, count(DISTINCT title) AS n_events, count(DISTINCT source_id) AS n_sources, count(DISTINCT source_id) FILTER (quality = 'primary') AS n_primary, count(DISTINCT title) FILTER (bad) AS n_negative FROM y GROUP BY 1, 2),
      r AS (SELECT *, least(90, 35 + 7 * least(n_events, 5) + 4 * least(n_sources, 5) + 3 * least(n_primary, 3) - 8 * n_negative) AS raw FROM g WHERE n_events >= 2 AND n_sources >= 2),
      theses AS (SELECT theme, entity, n_events, n_sources, n_primary, n_negative, CASE WHEN n_negative > n_events / 2 THEN 'weakened' WHEN n_negative > 0 THEN 'mixed' ELSE 'supported' END AS status, greatest(0, raw) AS strength,
      CASE WHEN raw >= 70 THEN 'high' WHEN raw >= 50 THEN 'moderate' ELSE 'early' END AS label, 'thesis-' || substring(sha256(theme || '|' || lower(entity)), 1, 20) AS thesis_id FROM r)"""


_SIGNED = f"""{ITEMS}, n AS (SELECT item_id, {_NORM.format(x='title')} AS t, {_NORM.format(x='summary')} AS s FROM items),
  signed AS (SELECT item_id, list_sort(list_distinct(list_concat(CASE WHEN len(string_split(t, ' ')) >= 5 AND NOT list_contains({_list(GENERIC_TITLES)}, t) THEN [sha256(t)] ELSE [] END,
  CASE WHEN len(string_split(s, ' ')) >= 10 THEN [sha256('event-summary:' || s)] ELSE [] END))) AS signatures FROM n)"""
_LISTING = """WITH l AS (SELECT user_id AS source, event_id AS native_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r <= 40),
  f AS (SELECT source, max(r) FILTER (r = CASE source % 3 WHEN 1 THEN 13 WHEN 2 THEN 33 END) AS spot, max(native_id) FILTER (r = CASE source % 3 WHEN 1 THEN 13 WHEN 2 THEN 33 END) AS boundary, max(r) AS n FROM l GROUP BY 1),
  t AS (SELECT l.*, f.* EXCLUDE (source) FROM l JOIN f USING (source) WHERE r <= 20 AND CASE WHEN spot IS NULL THEN r <= 10 WHEN spot <= 20 THEN r < spot ELSE false END)"""
_SAY_PLAIN = r"regexp_replace(trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g')), '([\\*_~`|>])', '\\\1', 'g')"


def _say(x: str, n: int) -> str:
    line = f"replace({_SAY_PLAIN.format(x=x)}, '@', '@\u200b')"
    return f"CASE WHEN length({line}) <= {n} THEN {line} ELSE rtrim(substring({line}, 1, {n - 1})) || '…' END"


def _one_naming(value: str, source: str) -> str:
    for short, names in NAMES.items():
        for long in names:
            has = [f"regexp_matches(lower({source}), '\\b{x}\\b')" for x in (short, long)]
            put = lambda gone, kept: f"regexp_replace({value}, '(?i)\\b{gone}\\s*\\(\\s*{kept}\\s*\\)|\\b{kept}\\s*\\(\\s*{gone}\\s*\\)|\\b{gone}\\b', '{kept}', 'g')"
            value = f"CASE WHEN {has[0]} AND NOT {has[1]} THEN {put(long, short.upper())} WHEN {has[1]} AND NOT {has[0]} THEN {put(short, long.title())} ELSE {value} END"
    return value


#: Names for words of the synthetic prose.
NAMES = {"thnt": ("thanedble", "attion"), "une": ("eriner",)}
_TITLE = "title || CASE WHEN item_id % 2 = 0 THEN ' launched today' WHEN item_id % 5 = 0 THEN ' plans to launch' ELSE '' END"
_NEWS = "lower(trim(regexp_replace(title || ' selected as custodian ' || CASE WHEN item_id % 4 = 0 THEN ' petition ' ELSE '' END || summary, '\\s+', ' ', 'g')))"


#: Events and pages as the items of a registry's sources, see ``queries.collected_items``.
_COLLECTED = """
WITH e AS (SELECT event_id, value, ts, event_id // 1200 AS place, event_type || ' by ' || user_id AS t,
                  ['feed-rss', 'feed-atom', 'feed-rdf', 'search', 'map', 'notices', 'news', 'releases', 'filings', 'shards', 'broken', 'off'][event_id % 12 + 1] AS source_id FROM events),
u AS (SELECT *, 'https://' || CASE WHEN value > 95 THEN 'elsewhere' ELSE source_id END || '.example/2024/' || event_id AS link, max(event_id) OVER (PARTITION BY source_id, place) AS last FROM e WHERE source_id <> 'off'),
i AS (SELECT source_id,
             CASE WHEN source_id IN ('feed-rdf', 'map') THEN link ELSE 'e' || event_id END AS native_id,
             CASE source_id WHEN 'map' THEN CAST(event_id AS VARCHAR) WHEN 'filings' THEN 'Co 8-K ' || t ELSE t END AS title,
             CASE WHEN source_id = 'search' AND value > 95 THEN 'https://news.example/articles/e' || event_id
                  WHEN source_id = 'filings' THEN 'https://filings.example/Archives/edgar/data/7/e' || event_id || '/d.htm' ELSE link END AS url,
             strftime(CASE WHEN source_id IN ('notices', 'filings', 'shards') THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS published_at,
             CASE WHEN source_id IN ('feed-rss', 'broken') THEN 'More & more' WHEN source_id = 'search' THEN 'x' WHEN source_id = 'feed-rdf' THEN left(repeat('many words ', 9), 40) ELSE '' END AS summary,
             CAST(place AS INT) AS place, CASE WHEN source_id = 'feed-rss' AND event_id % 5 = 0 THEN 2 ELSE 1 END AS n_places,
             CASE WHEN value > 95 AND source_id NOT IN ('filings', 'shards') THEN 'not an official link' END AS problem
      FROM u WHERE NOT (source_id IN ('filings', 'shards') AND value > 95) AND NOT (source_id = 'broken' AND place % 2 = 1 AND event_id = last)),
l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[A-Za-z]{3,})">', 1)) AS path FROM pages),
m AS (SELECT 'menus' AS source_id, path AS native_id, substr(path, 2) AS title, 'https://menus.example' || path AS url, CAST(NULL AS VARCHAR) AS published_at, '' AS summary,
             CAST(min(page_id) AS INT) AS place, count(DISTINCT page_id) AS n_places, CAST(NULL AS VARCHAR) AS problem
      FROM l WHERE lower(substr(path, 2)) NOT IN ('more', 'view', 'details') GROUP BY path),
a AS (SELECT * FROM i UNION ALL SELECT * FROM m)
"""
_STATUSES = (
    _COLLECTED
    + """,
n AS (SELECT source_id, count(DISTINCT place) + CASE WHEN source_id = 'feed-rss' THEN count(DISTINCT CASE WHEN event_id % 5 = 0 THEN place END) ELSE 0 END AS n_answers,
             CASE WHEN source_id = 'broken' THEN count(DISTINCT CASE WHEN place % 2 = 1 THEN place END) ELSE 0 END AS n_failures FROM u GROUP BY source_id
      UNION ALL SELECT 'menus', count(*), 0 FROM pages),
g AS (SELECT source_id, count(*) FILTER (problem IS NULL) AS n_rows, count(problem) AS n_problems FROM a GROUP BY source_id)
SELECT n.source_id, CASE WHEN n_rows > 0 AND n_problems + n_failures > 0 THEN 'partial' WHEN n_problems + n_failures > 0 THEN 'failed' WHEN n_rows = 0 THEN 'empty' ELSE 'success' END AS status,
       n_answers, n_rows, n_problems, n_failures,
       concat_ws('; ', CASE WHEN n_failures > 0 THEN 'a feed that is cut off' END, CASE WHEN n_problems > 0 THEN 'not an official link' END) AS reasons
FROM n JOIN g ON g.source_id = n.source_id
UNION ALL VALUES ('quiet', 'unread', 0, 0, 0, 0, ''), ('same', 'not_modified', 1, 0, 0, 0, ''), ('down', 'failed', 1, 0, 0, 1, 'status 503')
"""
)
_VERSION = """SELECT {v} AS version, o_custkey AS k, o_orderkey AS o, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '{until}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""

def _anchors(x: str) -> str:
    """Names and figures; letters beyond ASCII are part of words, which RE2's boundaries don't know."""
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({x}, '[^\\x00-\\x7F]', '_', 'g'), '{grounding.ANCHOR.removeprefix('(?U)')}'), lambda y: lower(y)), lambda y: NOT list_contains({_list(grounding.PLAIN)}, y))))"


def _holds(text: str, anchor: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9])' || regexp_escape({anchor}) || '($|[^a-z0-9])')"


def _unfounded(x: str, allowed: str) -> str:
    return f"list_filter({_anchors(f"regexp_replace({x}, '(?i)\\b(source|article)\\s*[-#]?\\s*\\d+\\b', '', 'g')")}, lambda a: NOT {_holds(allowed, 'a')} AND NOT (NOT regexp_matches(a, '\\d') AND {_holds('lower(publisher)', 'a')}))"


def _outside(name: str) -> str:
    return f"WHEN len(no_{name}) > 0 THEN '{name} names what no source does: ' || array_to_string(no_{name}[1:8], ', ')"


_THANEA = "(^|[^\\p{L}\\p{N}_])thanea($|[^\\p{L}\\p{N}_])"
_ANSWERS = f"""{ITEMS}, a0 AS (SELECT item_id, title, summary, coalesce(source_id, '') AS publisher, lower(title || chr(10) || summary) AS low, left(trim(title), 500) AS t1,
    left(trim(CASE WHEN item_id % 3 = 0 THEN 'Thanea ' ELSE '' END || title), 1000) AS said, left(trim('According to ' || coalesce(source_id, '') || ', ' || lower(left(summary, 300))), 500) AS t2,
    CASE WHEN item_id % 6 = 0 THEN 'Omegan lines go on' ELSE '' END AS why, CASE WHEN item_id % 5 = 0 THEN 'Quox' ELSE regexp_extract(title, '[A-Za-z]+') END AS entity FROM items),
  a1 AS (SELECT *, low || chr(10) || CASE WHEN item_id % 12 = 0 THEN 'omegan lines began' ELSE '' END AS wide,
    list_filter({_anchors('t1')}, lambda a: NOT {_holds('lower(summary)', 'a')}) AS m1, list_filter({_anchors('t2')}, lambda a: NOT {_holds('lower(publisher)', 'a')}) AS m2 FROM a0),
  a2 AS (SELECT *, list_filter(m1, lambda a: NOT {_holds('lower(title)', 'a')}) AS l1, list_filter(m2, lambda a: NOT {_holds('low', 'a')}) AS l2, {_holds('lower(title)', "'99%'")} AS n99,
    list_transform(list_filter(m2, lambda a: {_holds('low', 'a')}), lambda a: CASE WHEN {_holds('lower(title)', 'a')} THEN 'source-1 title' ELSE 'source-1 summary' END) AS s2,
    {_unfounded('said', 'low')} AS no_summary, {_unfounded('why', 'wide')} AS no_significance, {_unfounded("CASE WHEN item_id % 9 = 0 THEN 'Zubin denies source 1' ELSE '' END", 'low')} AS no_conflicts,
    {_unfounded("CASE WHEN item_id % 10 = 0 THEN 'Vexa is open' ELSE '' END", 'low')} AS no_uncertainties,
    item_id % 8 = 1 AND (NOT regexp_matches(low, 'thnt|thre') OR regexp_matches(low, '\\bsich\\b')) AS unborne FROM a1),
  a3 AS (SELECT *, CASE WHEN item_id % 13 = 0 THEN 'the answer is not JSON' WHEN item_id % 11 = 0 AND t1 <> '' THEN 'a claim cites no evidence that was given: source-2 title' WHEN unborne THEN 'no source bears out an acquisition'
      WHEN regexp_matches(lower(said || ' ' || why), '{_THANEA}') AND NOT regexp_matches(wide, '{_THANEA}') THEN 'the answer speaks of thanea, which no source does'
      WHEN len(l1) > 0 THEN 'a claim names ' || l1[1] || ', which no source does: ' || left(regexp_replace(t1, '\\s+', ' ', 'g'), 180) WHEN len(l2) > 0 THEN 'a claim names ' || l2[1] || ', which no source does: ' || left(regexp_replace(t2, '\\s+', ' ', 'g'), 180)
      WHEN item_id % 7 = 0 THEN 'a claim names ' || CASE WHEN {_holds('low', "'99%'")} THEN 'quoxel' ELSE '99%' END || ', which no source does: Quoxel takes 99% of it'
      WHEN entity <> '' AND NOT {_holds("lower(publisher || ' ' || title || ' ' || summary)", 'lower(entity)')} THEN 'an entity is in no source: ' || entity
      {_outside('summary')} {_outside('significance')} {_outside('conflicts')} {_outside('uncertainties')} ELSE '' END AS error FROM a2)"""


SQL = {
    "items_normalized": f"""WITH {ITEMS}, s AS (SELECT *, {_SQUEEZE.format(x='title')} AS t FROM items),
      p AS (SELECT *, regexp_extract(t, '^(.*?)[ ]+[|—–-][ ]+([^|—–]*)$', 2) AS tail FROM s)
      SELECT item_id, CASE WHEN length(tail) > 0 AND lower(tail) = lower(source_id) THEN regexp_extract(t, '^(.*?)[ ]+[|—–-][ ]+([^|—–]*)$', 1) ELSE t END AS title,
      {_SQUEEZE.format(x="regexp_replace(summary, '<[^>]*>', ' ', 'g')")} AS summary, 'https://' || lower(coalesce(source_id, 'none')) || '.example/' || item_id AS url, quality FROM p""",
    "item_keys": f"WITH {KEYS} SELECT item_id, fingerprint, event_key, 'item-' || substring(sha256(concat_ws('|', source_id, fingerprint)), 1, 24) AS candidate_id FROM keys",
    "first_arrivals": f"""WITH {KEYS}, f AS (SELECT event_key, min(item_id) AS item_id, count(*) - 1 AS n_copies FROM keys GROUP BY 1)
      SELECT f.event_key, f.item_id, f.n_copies, coalesce((SELECT string_agg(s, ',' ORDER BY arrived) FROM (SELECT k.source_id AS s, min(k.item_id) AS arrived FROM keys k WHERE k.event_key = f.event_key AND k.source_id <> o.source_id GROUP BY k.source_id)), '') AS duplicate_sources
      FROM f JOIN keys o USING (item_id)""",
    "duplicate_links": f"""WITH {KEYS}, f AS (SELECT event_key, min(item_id) AS item_id FROM keys GROUP BY 1)
      SELECT k.event_key, k.url, min(k.item_id) AS arrived FROM keys k JOIN f ON f.event_key = k.event_key JOIN keys o ON o.item_id = f.item_id WHERE k.url <> o.url GROUP BY ALL""",
    "unseen_items": f"WITH {ITEMS}, h AS (SELECT *, sha256(array_to_string({WORDS}, ' ')) AS headline FROM items) SELECT item_id, headline FROM h WHERE tm >= {HISTORY} AND headline NOT IN (SELECT headline FROM h WHERE tm < {HISTORY})",
    "entities": f"WITH {ENTITIES} SELECT item_id, array_to_string(entities, ',') AS entities FROM named",
    "relevance": f"WITH {SCORED} SELECT item_id, array_to_string(categories, ',') AS categories, score, array_to_string(reasons, '; ') AS reasons, {_BAND} AS band FROM scored",
    "source_yield": f"WITH {SCORED} SELECT coalesce(nullif(source_id, ''), 'unknown-source') AS source_key, count(*) AS observed, count(*) FILTER (score >= {GATE}) AS qualifying, max(score) AS best, count(*) FILTER (quality = 'primary') AS n_primary FROM scored GROUP BY 1",
    "score_bands": f"WITH {SCORED}, b AS (SELECT unnest(['0-14', '15-29', '30-49', '50-69', '70-100']) AS band) SELECT band, count(item_id) AS n_items FROM b LEFT JOIN scored ON {_BAND} = band GROUP BY 1",
    "publish_gates": f"""WITH {SCORED} SELECT item_id, CASE WHEN tm > {NOW} + 86400 THEN 'future' WHEN score < {GATE} THEN 'below'
      WHEN quality = 'high_signal' AND ({' OR '.join(f"contains(lower(title), '{m}')" for m in SAMPLE.commentary)}) THEN 'commentary' WHEN tm < {NOW} - 14 * 86400 THEN 'stale' ELSE 'publish' END AS disposition,
      CAST(greatest(0, floor(({NOW} - tm) / 86400)) AS INT) AS age_days FROM scored""",
    "audit_top": " UNION ALL ".join(f"SELECT * FROM (WITH {SCORED} SELECT '{part}' AS part, CAST(row_number() OVER (ORDER BY score DESC, lower(title), item_id) AS INT) AS rank, item_id, score FROM scored WHERE {which} QUALIFY rank <= 5)" for part, which in (("observed", "true"), ("below", f"score < {GATE}"))),
    "listing_digests": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sha256(string_agg('https://e.example/' || event_type || '/' || event_id, chr(92) || 'n' ORDER BY event_id)) AS digest FROM events GROUP BY 1, 2",
    "publish_top": f"WITH {SCORED} SELECT item_id, score FROM scored WHERE tm <= {NOW} + 86400 AND tm >= {NOW} - 14 * 86400 AND score >= {GATE} ORDER BY score DESC, tm DESC, lower(title), item_id LIMIT 10",
    "reconsidered_items": f"""WITH {SCORED}, k AS (SELECT item_id, event_key FROM (WITH {KEYS} SELECT * FROM keys)),
      o AS (SELECT * FROM (WITH {SCORED.replace("substring(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS summary", "'' AS summary")} SELECT item_id, score AS score_before FROM scored WHERE tm < {NOW})),
      x AS (SELECT s.item_id, score_before, score, tm, event_key FROM scored s JOIN k USING (item_id) LEFT JOIN o USING (item_id))
      SELECT item_id, score_before, score FROM x WHERE score_before < {GATE} AND score >= {GATE} AND tm >= {NOW} - 240 * 3600 AND tm < {NOW} AND event_key NOT IN (SELECT event_key FROM x WHERE tm >= {NOW})""",
    "correlation_by_tokens": f"WITH {CARDS}, {_pairs('card', 'card')}, {_ROLL} {_ROLLED}",
    "near_amounts": """SELECT x.o_custkey AS k, x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey
      WHERE abs(x.o_totalprice - y.o_totalprice) / greatest(abs(x.o_totalprice), abs(y.o_totalprice), 1) <= 0.03""",
    "graph_nodes": f"""WITH {ENTITIES}, x AS (SELECT item_id, unnest(entities) AS e FROM named) SELECT 'entity' AS type, count(DISTINCT lower(e)) AS n_nodes FROM x
      UNION ALL SELECT 'source', count(DISTINCT source_id) FROM named UNION ALL SELECT 'event', count(*) FROM named
      UNION ALL SELECT 'claim', CAST(sum(len(list_filter(string_split(summary, chr(10)), lambda x: x <> ''))) AS BIGINT) FROM named WHERE quality = 'primary'""",
    "graph_edges": f"""WITH {ENTITIES}, x AS (SELECT item_id, unnest(entities) AS e FROM named) SELECT 'entity:' || lower(e) AS src, 'mentioned_in' AS kind, count(*) AS n_events FROM x GROUP BY 1
      UNION ALL SELECT 'source:' || source_id, 'reports', count(*) FROM named WHERE source_id IS NOT NULL GROUP BY 1""",
    "supersession": f"WITH {ITEMS}, m AS (SELECT item_id, max(item_id) OVER (PARTITION BY title) AS new FROM items) SELECT item_id AS old, new FROM m WHERE item_id < new",
    "thesis_rollup": _theses() + " SELECT theme, entity, n_events, n_sources, n_primary, n_negative, status, strength, label, thesis_id FROM theses",
    "thesis_revisions": f"""WITH a AS ({_theses(f'tm < {HISTORY}')} SELECT * FROM theses), b AS ({_theses()} SELECT * FROM theses)
      SELECT thesis_id, CASE WHEN a.thesis_id IS NULL THEN 1 WHEN b.thesis_id IS NULL OR (a.status, a.strength, a.n_events, a.n_sources, a.n_primary, a.n_negative) = (b.status, b.strength, b.n_events, b.n_sources, b.n_primary, b.n_negative) THEN 1 ELSE 2 END AS revision,
      CASE WHEN a.thesis_id IS NULL THEN 'run' ELSE 'history' END AS first_seen, CASE WHEN b.thesis_id IS NULL THEN 'history' ELSE 'run' END AS updated_at, coalesce(b.status, a.status) AS status, coalesce(b.strength, a.strength) AS strength FROM a FULL JOIN b USING (thesis_id)""",
    "thesis_context": f"""WITH t AS ({_theses()} SELECT * FROM theses), n AS (WITH {ENTITIES} SELECT item_id, unnest(entities) AS entity FROM named)
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY CASE status WHEN 'supported' THEN 2 WHEN 'mixed' THEN 1 ELSE 0 END DESC, strength DESC, thesis_id DESC) AS INT) AS rank, thesis_id FROM n JOIN t USING (entity) QUALIFY rank <= 3""",
    "event_freshness": f"""WITH {ITEMS} SELECT sha256(title) AS headline, count(*) AS n_evidence, CASE WHEN max(tm) > {NOW} + 86400 THEN 'future' WHEN max(tm) < {NOW} - 10 * 86400 THEN 'stale' ELSE 'fresh' END AS freshness FROM items GROUP BY 1""",
    "event_evidence": f"""WITH {ITEMS}, r AS (SELECT sha256(title) AS headline, url, row_number() OVER (PARTITION BY title ORDER BY tm DESC, url DESC) AS r FROM items) SELECT headline, string_agg(url, ' ' ORDER BY r) AS urls, count(*) AS n_urls FROM r WHERE r <= 12 GROUP BY 1""",
    "weekly_digest": f"WITH {ITEMS} SELECT source_id, count(*) AS n_posts FROM items WHERE tm BETWEEN {START + 17 * 86400} AND {NOW} GROUP BY 1 ORDER BY 2 DESC, min(struct_pack(tm, item_id)) LIMIT 5",
    "queue_health": f"WITH {ITEMS} SELECT count(*) AS n_rows, CAST(min({NOW} - tm) AS BIGINT) AS youngest_s, CAST(max({NOW} - tm) AS BIGINT) AS oldest_s FROM items WHERE tm <= {NOW}",
    "health_streaks": f"{_STREAKS} SELECT event_id, CAST(nf AS BIGINT) AS consecutive_failures, CAST(ne AS BIGINT) AS consecutive_empty, epoch_us(began) AS started_us FROM d",
    "health_warnings": f"{_STREAKS} SELECT event_id, user_id AS source_id, status FROM d WHERE status <> 'success' AND epoch_us(ts) // 1000000 - epoch_us(began) // 1000000 >= 86400",
    "change_detection": f"{_HALVES} SELECT user_id, CASE WHEN o.user_id IS NULL THEN 'new' WHEN n.user_id IS NULL THEN 'gone' WHEN o.event_type = n.event_type THEN 'unchanged' ELSE 'changed' END AS change FROM old o FULL JOIN new n USING (user_id)",
    "keyed_upsert": f"{_HALVES} SELECT user_id, coalesce(o.event_id, n.event_id) AS event_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n USING (user_id)",
    "insert_if_absent": f"{_HALVES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)",
    "key_collisions": f"{_HALVES} SELECT user_id FROM old o JOIN new n USING (user_id) WHERE o.event_type <> n.event_type",
    "event_revisions": """WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM x WHERE was IS DISTINCT FROM event_type)
      SELECT user_id, max(n) AS n_revisions, string_agg(event_type, ',' ORDER BY r) AS history FROM y WHERE r > n - 10 GROUP BY 1""",
    "retention_per_source": f"WITH {ITEMS} SELECT item_id, source_id FROM items QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY tm DESC, item_id DESC) <= 20",
    "undelivered_orders": "SELECT o_orderkey AS key, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '1995-06-01')",
    "source_rotation": "SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p, count(*) OVER () AS n FROM supplier) WHERE ((p - 7) % n + n) % n < 25",
    "listing_frontier": f"{_LISTING} SELECT source, CAST((r - 1) // 10 AS INT) AS page, CAST((r - 1) % 10 AS INT) AS place, native_id FROM t",
    "event_signatures": f"WITH {_SIGNED} SELECT item_id, array_to_string(signatures, ',') AS signatures FROM signed",
    "undelivered_events": f"""WITH {_SIGNED} SELECT item_id AS event_id FROM signed WHERE item_id % 7 <> 0 AND NOT list_has_any(signatures, (SELECT flatten(list(signatures)) FROM signed WHERE item_id % 7 = 1))""",
    "stated_negatives": f"WITH {ITEMS}, {STATED} SELECT item_id, item_id IN (SELECT item_id FROM stated) AS negative FROM items",
    "context_for_items": f"""WITH {ITEMS}, w AS (SELECT item_id, ' ' || array_to_string({_words("concat_ws(' ', title, summary)")}, ' ') || ' ' AS said FROM items),
      r AS (SELECT item_id AS record_id, {_words('text')} AS a, CAST(item_id % 5 AS VARCHAR) AS topic FROM benchmark),
      m AS (SELECT w.item_id, record_id, topic, (CASE WHEN len(a) >= 2 THEN 3 + least(2, len(a) - 2) ELSE 2 END) * 4 + 2 * 3 + 4 AS score FROM w JOIN r ON len(a) > 0 AND contains(said, ' ' || array_to_string(a, ' ') || ' ')),
      p AS (SELECT *, row_number() OVER (PARTITION BY item_id, topic ORDER BY score DESC, record_id DESC) - 1 AS place FROM m),
      v AS (SELECT *, score + CASE WHEN place = 0 THEN 5 ELSE -5 * place END AS worth FROM p)
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY worth DESC, record_id DESC) AS INT) AS rank, record_id FROM v QUALIFY rank <= 3""",
    "candidates_normalized": f"""WITH {ITEMS}, u AS (SELECT *, {_SQUEEZE.format(x='title')} AS t, {_SQUEEZE.format(x="regexp_replace(summary, '<[^>]*>', ' ', 'g')")} AS s, 'https://' || lower(coalesce(source_id, 'none')) || '.example/' || item_id AS c FROM items)
      SELECT item_id, t AS title, s AS summary, c AS url, c AS provenance, CASE WHEN item_id % 5 = 0 THEN 'own' ELSE 'item-' || substring(sha256(concat_ws('|', source_id, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) ELSE c END)), 1, 24) END AS candidate_id FROM u""",
    "publication_keys": f"""WITH {KEYS} SELECT item_id, CASE WHEN item_id % 3 = 0 AND source_id IS NOT NULL THEN 'chat|' || source_id ELSE 'chat|' || CASE WHEN item_id % 2 = 0 THEN 'id' ELSE fingerprint END || '|' || CASE WHEN item_id % 5 = 0 THEN 'hash' ELSE fingerprint END END AS key FROM keys""",
    "recommended_actions": f"""WITH {ITEMS}, g AS (SELECT title, max(tm) AS newest, bool_or(tm BETWEEN {NOW - 10 * 86400} AND {NOW + 86400}) AS eligible FROM items GROUP BY 1)
      SELECT sha256(title) AS headline, CASE WHEN newest > {NOW + 86400} THEN 'hold: dated in the future' WHEN newest < {NOW - 10 * 86400} THEN 'quarantine: stale' WHEN trim(lower(title)) IN ('', {_list(GENERIC_TITLES)[1:-1]}) THEN 'quarantine: titles say nothing' ELSE 'review' END AS action, eligible FROM g""",
    "allowed_items": f"WITH {ITEMS} SELECT item_id, url FROM items WHERE item_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "saved_progress": f"""WITH a AS (SELECT event_id, value, {_STATUS} AS status, json_extract(props, '$.k') IS NOT NULL AS progress FROM events)
      SELECT event_id, progress, status <> 'failed' AND (value > 50 OR status = 'empty' OR (progress AND value > 20)) AS saved FROM a""",
    "state_inventory": " UNION ALL ".join(f"SELECT '{n}' AS state, count(*) AS n_rows FROM {n}" for n in ("documents", "events", "orders", "labels", "benchmark")),
    "model_selection": f"WITH {SCORED} SELECT CAST(row_number() OVER (ORDER BY score DESC, len(entities), tm DESC, lower(title), item_id) AS INT) AS rank, item_id, score FROM scored WHERE score >= {GATE} QUALIFY rank <= 12",
    "near_misses": f"WITH {SCORED} SELECT item_id, score FROM scored WHERE score < {GATE} ORDER BY score DESC, tm DESC, lower(title), item_id LIMIT 5",
    "outbox_first": "SELECT o_orderkey AS key FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "observation_preview": "SELECT CAST(row_number() OVER (ORDER BY ts DESC, user_id DESC, event_id DESC) AS INT) AS rank, event_id FROM events QUALIFY rank <= 20",
    "retained_cards": f"WITH {ITEMS} SELECT item_id FROM items WHERE tm >= {NOW} - 72 * 3600 ORDER BY tm DESC, item_id DESC LIMIT 500",
    "seen_fingerprints": f"""WITH {KEYS}, o AS (SELECT item_id AS place, fingerprint FROM keys WHERE tm < {HISTORY}), n AS (SELECT DISTINCT fingerprint FROM keys WHERE fingerprint NOT IN (SELECT fingerprint FROM o)),
      e AS (SELECT * FROM o UNION ALL SELECT (SELECT max(place) FROM o) + row_number() OVER (ORDER BY fingerprint), fingerprint FROM n) SELECT * FROM e ORDER BY place DESC LIMIT 500""",
    "released_retries": f"WITH {KEYS} SELECT fingerprint FROM keys WHERE NOT (item_id % 3 = 0 AND item_id IN (SELECT doc_id FROM labels WHERE quality = 0))",
    "merged_branches": """SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey <> 1 AND c_nationkey <> 3 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderdate <= TIMESTAMP '1995-12-02')
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1997-01-01')""",
    "prior_events": f"""WITH {ENTITIES}, c AS MATERIALIZED (SELECT item_id, tm, CAST(day AS DATE) AS day, entities, list_filter(list_distinct({WORDS}), lambda x: NOT list_contains({_list(STOPWORDS)}, x) AND (length(x) > 2 OR regexp_matches(x, '^[0-9]+$'))) AS tokens FROM named WHERE len(entities) > 0),
      m AS (SELECT l.item_id, r.item_id AS event_id, r.day, list_intersect(l.entities, r.entities) AS shared, list_intersect(l.tokens, r.tokens) AS common FROM c l JOIN c r ON l.tm >= {HISTORY} AND r.tm < {HISTORY} AND list_has_any(l.entities, r.entities)),
      s AS (SELECT *, len(shared) * 3 + len(common) AS score FROM m WHERE len(list_filter(common, lambda x: NOT list_contains(list_transform(shared, lambda e: lower(e)), x))) >= 2)
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, day, event_id) AS INT) AS rank, event_id, score FROM s QUALIFY rank <= 3""",
    "parameter_products": "SELECT CAST(y AS INT) AS year, k AS kind, (SELECT count(*) FROM events WHERE year(ts) = y AND event_type = k) AS n_events FROM (SELECT unnest([2023, 2024]) AS y), (SELECT unnest(['click', 'error', 'purchase', 'view']) AS k)",
    "acronyms": f"""WITH {ITEMS} SELECT item_id, sha256({_one_naming("('Thnt (Thanedble), Eriner and une. ' || title)", 'summary')}) AS named FROM items""",
    "event_types": f"""WITH {ITEMS}, g AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'announcement' WHEN 1 THEN 'filing' ELSE 'acquisition' END AS given, lower(trim({_TITLE})) AS head, {_NEWS} AS said FROM items)
      SELECT item_id, CASE WHEN given = 'announcement' AND regexp_matches(head, '\\blaunch(es|ed)?\\b') AND NOT regexp_matches(head, '\\bto launch\\b|\\bplanned launch\\b') THEN 'product_launch'
      WHEN given = 'filing' AND NOT regexp_matches(said, '\\b(filed|filing|submitted|petition|complaint|motion|registration statement|form [a-z0-9-]+)\\b') THEN 'partnership'
      WHEN given = 'acquisition' AND (NOT (contains(said, 'thnt') OR contains(said, 'thre')) OR regexp_matches(said, '\\bsich\\b')) THEN NULL ELSE given END AS event_type FROM g""",
    "grounded_answers": f"""WITH {_ANSWERS} SELECT item_id, error = '' AS ok, error, CASE WHEN item_id % 13 = 0 THEN 'other' WHEN item_id % 8 = 1 THEN 'acquisition' WHEN item_id % 8 = 2 THEN CASE WHEN regexp_matches(lower(title), '\\blaunch(es|ed)?\\b') THEN 'product_launch' ELSE 'announcement' END ELSE 'other' END AS event_type,
      CASE WHEN item_id % 13 = 0 THEN '' ELSE concat_ws('; ', CASE WHEN t1 <> '' THEN 'source-1 summary' || CASE WHEN len(m1) > len(l1) THEN ',source-1 title' ELSE '' END END, array_to_string(list_sort(list_distinct(list_append(s2, 'source-1 publisher'))), ','),
        CASE WHEN item_id % 7 = 0 THEN 'source-1 title' || CASE WHEN {_holds('lower(summary)', "'99%'")} AND NOT n99 THEN ',source-1 summary' ELSE '' END END, CASE WHEN item_id % 11 = 0 AND t1 <> '' THEN concat_ws(',', CASE WHEN len({_anchors('t1')}) > 0 THEN 'source-1 title' END, 'source-2 title') END) END AS labels FROM a3""",
    "event_messages": f"""WITH {ENTITIES}, m AS (SELECT *, list_sort(list_distinct(entities)) AS names FROM named) SELECT item_id, sha256(concat_ws(chr(10), CASE WHEN quality = 'primary' THEN '**Partnership**' ELSE '**Regulatory Action**' END, {_say('title', 420)},
      CASE WHEN item_id % 2 = 0 AND trim(summary) <> '' THEN CASE WHEN quality = 'primary' THEN '**Strategic read-through:** ' ELSE '**Why it matters:** ' END || {_say('summary', 700)} END, '**Status:** reported',
      CASE WHEN len(names) > 0 THEN '**Key entities:** ' || array_to_string(names[1:6], ', ') END, '**Grounded updates:**' || chr(10) || '• ' || CASE WHEN quality = 'primary' THEN '*confirmed* — ' ELSE '' END || {_say('title', 240)},
      CASE WHEN len(entities) > 0 THEN '**Still unclear:**' || chr(10) || array_to_string(list_transform(entities[1:3], lambda x: '• ' || x), chr(10)) END,
      '**Sources:**' || chr(10) || '• ' || concat_ws(' · ', CASE quality WHEN 'primary' THEN 'Primary source' WHEN 'high_signal' THEN 'Independent reporting' ELSE 'Source' END, coalesce(nullif({_say('title', 130)}, ''), {_say("coalesce(source_id, '')", 80)}), day) || chr(10) || '  ' || url,
      CASE WHEN item_id % 5 = 0 THEN '**Updated by:** event-a, event-b' END)[:2000]) AS message FROM m""",
    "evaluation_counts": f"WITH {ITEMS} SELECT regexp_matches(lower(title), 'th') AND regexp_matches(lower(title), 't.e') AND NOT regexp_matches(lower(title), 'qu|oi') AS passed, count(*) AS n_cases FROM items GROUP BY 1",
    "stream_daily_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "category_rules": f"""WITH {ENTITIES}, r AS (SELECT item_id, title, source_id, quality, {BOTH} AS t, entities FROM named),
        a AS (SELECT *, list_contains(entities, 'Thanea') AND ({_has('t', SAMPLE.terms['topic'])} OR {_has('t', ('and the', 'auch nicht'))}) AS surface,
                     {_has('title', SAMPLE.terms['action'])} OR regexp_matches(title, '^(The|Th[a-z]+|Die|Ni[a-z]+) ') AS headline FROM r)
        SELECT item_id, concat_ws(',', CASE WHEN surface THEN 'surface' END, CASE WHEN regexp_matches(t, '{phrase_pattern(('Une', 'Elle', 'Thre')).removeprefix('(?i)')}') THEN 'written' END,
          CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-z]+ing($|[^\\p{{L}}\\p{{N}}_])') AND NOT surface THEN 'patterned' END, CASE WHEN headline THEN 'headline' END,
          CASE WHEN source_id IN ('src1', 'src7', 'src14') AND (quality = 'primary' OR headline) THEN 'desk' END,
          CASE WHEN CAST({_has('t', SAMPLE.terms['action'])} AS INT) + CAST({_has('t', SAMPLE.terms['quiet'])} AS INT) + CAST(list_has_any(entities, {_list(SAMPLE.entities['authority'])}) AS INT) >= 2 THEN 'two' END) AS categories FROM a""",
    "lexicon_phrases": f"""WITH {ITEMS}, b AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
        l AS (SELECT DISTINCT w[k] AS x, w[k + 1] AS y FROM (SELECT w, unnest(range(1, len(w))) AS k FROM b)),
        p AS (SELECT item_id, string_split(lower({BOTH}), ' ') AS p FROM items),
        e AS (SELECT item_id, p[k] AS a, p[k + 1] AS z FROM (SELECT item_id, p, unnest(range(1, len(p))) AS k FROM p)),
        f AS (SELECT DISTINCT item_id, x || ' ' || y AS phrase FROM (SELECT item_id, regexp_extract(a, '([\\p{{L}}\\p{{N}}_]+)$', 1) AS x, regexp_extract(z, '^([\\p{{L}}\\p{{N}}_]+)', 1) AS y FROM e) JOIN l USING (x, y)),
        g AS (SELECT item_id, count(*) AS n, string_agg(phrase, ',' ORDER BY phrase) AS s FROM f GROUP BY item_id)
        SELECT item_id, coalesce(n, 0) AS n_phrases, sha256(coalesce(s, '')) AS phrases FROM items LEFT JOIN g USING (item_id)""",
    "collected_items": _COLLECTED + "SELECT source_id, native_id, title, url, published_at, summary, place, CAST(n_places AS BIGINT) AS n_places, problem FROM a",
    "collected_statuses": _STATUSES,
    "stream_listing": """SELECT source, native_id, title FROM (SELECT CAST(user_id % 20 AS VARCHAR) AS source, CAST(event_id AS VARCHAR) AS native_id, event_type AS title, ts, ts >= TIMESTAMP '2024-01-16' AS late FROM events WHERE ts < TIMESTAMP '2024-03-01')
        QUALIFY late OR row_number() OVER (PARTITION BY source, late ORDER BY ts DESC, native_id DESC) <= 100""",
    "stream_trailing": """SELECT user_id, event_id, CASE WHEN before_ts IS NULL OR epoch_us(ts) - epoch_us(before_ts) > 86400000000 THEN 'new' WHEN was = event_type THEN 'same' ELSE 'changed' END AS change,
        CASE WHEN before_ts IS NULL OR epoch_us(ts) - epoch_us(before_ts) > 86400000000 THEN NULL ELSE was END AS before
        FROM (SELECT *, lag(ts) OVER w AS before_ts, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "snapshot_versions": f"""WITH v AS ({_VERSION.format(v=1, until='1994-01-01')} UNION ALL {_VERSION.format(v=2, until='1996-01-01')} UNION ALL {_VERSION.format(v=3, until='1999-01-01')}),
        old AS (SELECT * FROM v WHERE version = 3 AND price <= 300000), new AS (SELECT * FROM v WHERE version = 1 AND price <= 300000)
        SELECT version, CASE WHEN price > 300000 THEN 'too dear' ELSE 'kept' END AS what, k, o FROM v
        UNION ALL SELECT 0, CASE WHEN old.k IS NULL THEN 'new' WHEN new.k IS NULL THEN 'gone' ELSE 'changed' END, coalesce(old.k, new.k), 0
        FROM old FULL OUTER JOIN new ON old.k = new.k WHERE old.k IS NULL OR new.k IS NULL OR old.o <> new.o OR old.price <> new.price""",
    "stream_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_cards": "SELECT user_id, event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id",
    "cluster_members": """WITH RECURSIVE e AS (SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey WHERE abs(x.o_totalprice - y.o_totalprice) / greatest(abs(x.o_totalprice), abs(y.o_totalprice), 1) <= 0.03),
      reach(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id), c AS (SELECT id AS o_orderkey, min(root) AS root FROM reach GROUP BY 1), m AS (SELECT * FROM c JOIN orders USING (o_orderkey))
      SELECT 'cluster-' || substring(sha256(string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 24) AS cluster_id, count(*) AS n_members, count(DISTINCT o_orderpriority) AS n_sources, max(CAST(floor(o_totalprice) AS INT)) AS best_score,
      arg_max(o_orderkey, struct_pack(s := floor(o_totalprice), t := -epoch(o_orderdate), k := -o_orderkey)) AS representative, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderpriority, 'https://shop.example/' || o_orderkey) AS members FROM m GROUP BY root""",
    "frontier_state": f"""{_LISTING}, k AS (SELECT source, max_by(native_id, r) AS taken FROM t GROUP BY 1)
      SELECT source, coalesce(taken, boundary) AS boundary_id, CAST(CASE WHEN spot IS NULL THEN 1 WHEN spot <= 20 THEN CASE WHEN taken IS NOT NULL THEN (spot - 1) // 10 + 1 ELSE 1 END WHEN (least(n, 20) - 1) // 10 > 0 THEN (least(n, 20) - 1) // 10 + 1 ELSE 1 END AS INT) AS hint,
      CASE WHEN spot IS NULL THEN 'initial' WHEN spot <= 20 THEN 'found' ELSE 'missing' END AS status FROM f LEFT JOIN k USING (source)""",
    "term_frontiers": """WITH o AS (SELECT user_id AS term, max(struct_pack(ts, event_id)) AS f FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), a AS (SELECT user_id AS term, max(struct_pack(ts, event_id)) AS l FROM events GROUP BY 1)
      SELECT term, (SELECT count(*) FROM events e WHERE e.user_id = term AND (f IS NULL OR struct_pack(ts := e.ts, event_id := e.event_id) > f)) AS n_fresh, l.event_id AS native_id FROM a LEFT JOIN o USING (term)""",
    "messages": f"""WITH {ENTITIES}, m AS (SELECT *, coalesce(nullif({_clip('title', 220)}, ''), 'Untitled source item') AS t, {_clip('summary', 360)} AS s, array_to_string(entities[1:4], ', ') AS e FROM named)
      SELECT item_id, concat_ws(chr(10), '**' || t || '**', nullif(s, ''), '*' || coalesce(source_id, 'Unknown source') || ' · ' || day || CASE WHEN e <> '' THEN ' · ' || e ELSE '' END || '*', 'Source: ' || url) AS message FROM m""",
    "event_properties": "SELECT event_type, count(*) AS n_events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1",
    "conversation_bundles": """WITH f AS (SELECT conv_id, role, text, min(turn) AS turn FROM conversations GROUP BY 1, 2, 3) SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn, role) AS roles FROM f GROUP BY 1""",
}
