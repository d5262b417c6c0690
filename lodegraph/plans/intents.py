"""Query routing, prompt intents, usage signals, parsing of texts and pages, sinks."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..sources.bindings import sql
from ..sources.scratch import folder, stored
from .catalog import query

# The patterns of the three query intents, scored by the number of their matches.
ROUTES = {
    "LOCAL": (r"\b(the|and)\b", r"[a-z]+_[a-z]+"),
    "GLOBAL": (r"\b(all|list|every|license)\b", r"\bof\b"),
    "HYBRID": (r"\b(how|why|und)\b",),
}


def route_scores(text: Column) -> dict[str, Column]:
    """Matches of each intent's patterns in the lower-cased text."""
    low = F.lower(text)
    scores = {}
    for intent, patterns in ROUTES.items():
        total = F.lit(0)
        for p in patterns:
            total = total + F.regexp_count(low, F.lit(p))
        scores[intent] = total
    return scores


_ROUTE = r"""SELECT item_id, len(regexp_extract_all(lower(text), '\b(the|and)\b')) + len(regexp_extract_all(lower(text), '[a-z]+_[a-z]+')) AS local_score,
 len(regexp_extract_all(lower(text), '\b(all|list|every|license)\b')) + len(regexp_extract_all(lower(text), '\bof\b')) AS global_score, len(regexp_extract_all(lower(text), '\b(how|why|und)\b')) AS hybrid_score FROM benchmark"""


def _routed(t):
    s = route_scores(F.col("text"))
    return t.benchmark.select("item_id", "text", s["LOCAL"].alias("local_score"), s["GLOBAL"].alias("global_score"), s["HYBRID"].alias("hybrid_score"))


@query("f12_query_router", f"SELECT item_id, intent, round(top / greatest(total, 1), 4) AS confidence FROM (SELECT item_id, greatest(local_score, global_score, hybrid_score) AS top, local_score + global_score + hybrid_score AS total, CASE WHEN local_score >= global_score AND local_score >= hybrid_score THEN 'LOCAL' WHEN global_score >= hybrid_score THEN 'GLOBAL' ELSE 'HYBRID' END AS intent FROM ({_ROUTE}))")
def f12(t):
    a, b, c = F.col("local_score"), F.col("global_score"), F.col("hybrid_score")
    intent = F.when((a >= b) & (a >= c), "LOCAL").when(b >= c, "GLOBAL").otherwise("HYBRID")
    return _routed(t).select("item_id", intent.alias("intent"), F.round(F.greatest(a, b, c) / F.greatest(a + b + c, F.lit(1)), 4).alias("confidence"))


@query("f13_natural_language", r"SELECT item_id, len(string_split(text, ' ')) >= 3 OR regexp_matches(lower(text), '^(how|what|why) ') AS natural FROM benchmark")
def f13(t):
    return t.benchmark.select("item_id", ((F.size(F.split("text", " ", -1)) >= 3) | F.lower("text").rlike("^(how|what|why) ")).alias("natural"))


# Weights of vector, keyword and graph search, hops and result limit of each intent.
STRATEGIES = {"LOCAL": (0.6, 0.3, 0.1, 2, 5), "GLOBAL": (0.2, 0.3, 0.5, 4, 15), "HYBRID": (0.4, 0.3, 0.3, 3, 10)}
_PARTS = ("vector_weight", "keyword_weight", "graph_weight", "hops", "result_limit")


@query("f14_search_strategy", "SELECT item_id, intent, greatest(vector_weight, CASE WHEN len(string_split(text, ' ')) >= 3 OR regexp_matches(lower(text), '^(how|what|why) ') THEN 0.6 ELSE 0 END)::DOUBLE AS vector_weight, keyword_weight::DOUBLE AS keyword_weight, graph_weight::DOUBLE AS graph_weight, hops, result_limit FROM (SELECT item_id, text, CASE WHEN local_score >= global_score AND local_score >= hybrid_score THEN 'LOCAL' WHEN global_score >= hybrid_score THEN 'GLOBAL' ELSE 'HYBRID' END AS intent FROM (" + _ROUTE.replace("SELECT item_id,", "SELECT item_id, text,") + ")) JOIN (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in STRATEGIES.items()) + f") s(intent, {', '.join(_PARTS)}) USING (intent)")
def f14(t):
    """The intent's strategy; a sentence in natural language raises the weight of vectors to 0.6."""
    a, b, c = F.col("local_score"), F.col("global_score"), F.col("hybrid_score")
    routed = _routed(t).withColumn("intent", F.when((a >= b) & (a >= c), "LOCAL").when(b >= c, "GLOBAL").otherwise("HYBRID"))
    of = F.create_map(*[x for k, v in STRATEGIES.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for y, n in zip(v, _PARTS, strict=True)]))])
    sentence = (F.size(F.split("text", " ", -1)) >= 3) | F.lower("text").rlike("^(how|what|why) ")
    found = routed.select("item_id", "intent", sentence.alias("sentence"), F.element_at(of, F.col("intent")).alias("s")).select("item_id", "intent", "sentence", "s.*")
    return found.withColumn("vector_weight", F.greatest("vector_weight", F.when(F.col("sentence"), 0.6).otherwise(0.0))).drop("sentence")


# Words of the prompt intents, three points for each that occurs; the first of the best wins.
PROMPT_INTENTS = {"DEBUG": ("is", "not"), "TEST": ("with", "that"), "REFACTOR": ("from", "on"), "DOCUMENT": ("der", "die"), "DESIGN": ("le", "la")}


@query("f15_prompt_intent", "SELECT conv_id, turn, CASE WHEN m = 0 THEN 'IMPLEMENT' WHEN a = m THEN 'DEBUG' WHEN b = m THEN 'TEST' WHEN c = m THEN 'REFACTOR' WHEN d = m THEN 'DOCUMENT' ELSE 'DESIGN' END AS intent, m AS points FROM (SELECT *, greatest(a, b, c, d, e) AS m FROM (SELECT conv_id, turn, " + ", ".join(f"{' + '.join(f'3 * CAST(list_contains(w, {chr(39)}{x}{chr(39)}) AS INT)' for x in words)} AS {name}" for name, words in zip("abcde", PROMPT_INTENTS.values(), strict=True)) + " FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) AS w FROM conversations WHERE role = 'user')))")
def f15(t):
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", X.tokens(F.col("text")).alias("w"))
    points = [3 * F.array_contains("w", a).cast("int") + 3 * F.array_contains("w", b).cast("int") for a, b in PROMPT_INTENTS.values()]
    scored = rows.select("conv_id", "turn", F.array(*points).alias("p")).withColumn("m", F.array_max("p"))
    names = X.strings(list(PROMPT_INTENTS))
    first = F.element_at(names, F.array_position("p", F.col("m")).cast("int"))
    return scored.select("conv_id", "turn", F.when(F.col("m") == 0, "IMPLEMENT").otherwise(first).alias("intent"), F.col("m").alias("points"))


# What stands for a target in a prompt, tried in this order; of the fourth's finds the longest counts, of the others' the
# first. \w and \b know letters beyond ASCII in some engines only, so accents are folded before the patterns are tried.
TARGET_PATTERNS = (
    r"(\b[a-zA-Z_]\w+(?:_\w+)*)\s*(?:함수|클래스|메서드|모듈)(?:를|을|의|에)",
    r"(\b[a-zA-Z_]\w{2,})\s*(?:에서|에 대한)",
    r"(?:함수|클래스|메서드|모듈)\s+(\b[a-zA-Z_]\w+(?:_\w+)*)",
    r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b",
    r"\b([A-Z][a-zA-Z0-9]{2,})\b",
    r"(\w+)\.(py|ts|js|tsx|jsx)\b",
)
# Capitalised words that name nothing.
NO_TARGETS = ("The", "This", "That", "What", "How", "For", "With", "From", "About", "After", "Before", "MANDATORY", "BEFORE", "DEVELOPMENT", "Knowledge", "Skipping")
_ACCENTS = ("àâäçèéêëîïíìñóòôöùûüúßÀÂÄÇÈÉÊËÎÏÍÌÑÓÒÔÖÙÛÜÚ", "aaaceeeeiiiinoooouuuusAAACEEEEIIIINOOOOUUUU")
#: Prompts that name a function, in the ways that the patterns know.
_ASKED = ("{} 함수를 고쳐줘", "{}에서 오류", "새 함수 {}", "fix {} as x_y", "open {}.py")


def _prompts(t):
    fold = lambda c: F.translate(c, *_ACCENTS)
    said = t.conversations.where("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), fold(F.col("text")).alias("prompt"))
    items = t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("id"), fold(F.col("text")).alias("prompt"))
    number = F.substring("id", 2, 20).cast("long") % len(_ASKED)
    name = F.replace("name", F.lit(" "), F.lit("_"))
    asked = F.when(number < 0, F.lit(None).cast("string"))
    for i, form in enumerate(_ASKED):
        asked = asked.when(number == i, F.format_string(form.replace("{}", "%s"), F.col("id") if i == 4 else name))
    return said.unionByName(items).unionByName(t.functions.select("id", asked.alias("prompt")))


_PROMPTS = f""", prompts AS (SELECT 'c' || conv_id || '.' || turn AS id, translate(text, '{_ACCENTS[0]}', '{_ACCENTS[1]}') AS prompt FROM conversations WHERE role = 'user'
 UNION ALL SELECT 'b' || item_id, translate(text, '{_ACCENTS[0]}', '{_ACCENTS[1]}') FROM benchmark
 UNION ALL SELECT id, CASE CAST(substr(id, 2) AS BIGINT) % 5 """ + " ".join(f"WHEN {i} THEN format('{form}', {'id' if i == 4 else 'replace(name, chr(32), chr(95))'})" for i, form in enumerate(_ASKED)) + " END FROM functions)"
_FIND = lambda i: f"nullif(regexp_extract(prompt, '{TARGET_PATTERNS[i]}', 1), '')"


@query("f16_target_extraction", sql(_PROMPTS + f""" SELECT id, coalesce({_FIND(0)}, {_FIND(1)}, {_FIND(2)},
  (list_sort(list_transform(list_zip(snakes, range(len(snakes))), lambda z: {{'n': -length(z[1]), 'i': z[2], 'x': z[1]}})))[1].x, pascals[1], {_FIND(5)}, 'none') AS target
 FROM (SELECT id, prompt, regexp_extract_all(prompt, '{TARGET_PATTERNS[3]}', 1) AS snakes, list_filter(regexp_extract_all(prompt, '{TARGET_PATTERNS[4]}', 1), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in NO_TARGETS)})) AS pascals FROM prompts)""", "functions"))
def f16(t):
    """The first pattern that finds something: named kinds, the longest word in snake case, the first in capitals, a file."""
    pick = lambda i: F.nullif(F.regexp_extract("prompt", TARGET_PATTERNS[i], 1), F.lit(""))
    every = lambda i: F.regexp_extract_all("prompt", F.lit(TARGET_PATTERNS[i]), 1)
    longest = F.nullif(F.aggregate(every(3), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)), F.lit(""))
    pascals = F.filter(every(4), lambda x: ~x.isin(*NO_TARGETS))
    return _prompts(t).select("id", F.coalesce(pick(0), pick(1), pick(2), longest, F.try_element_at(pascals, F.lit(1)), pick(5), F.lit("none")).alias("target"))


# Weights of words that tell a development context.
CONTEXT_WEIGHTS = {"license": 3, "version": 2, "the": 1, "und": 1}


@query("f17_weighted_gate", "SELECT doc_id, score, score >= 3 AS passes FROM (SELECT doc_id, " + " + ".join(f"{w} * CAST(contains(lower(text), '{k}') AS INT)" for k, w in CONTEXT_WEIGHTS.items()) + " AS score FROM documents)")
def f17(t):
    low, score = F.lower("text"), F.lit(0)
    for k, w in CONTEXT_WEIGHTS.items():
        score = score + w * F.contains(low, F.lit(k)).cast("int")
    return t.documents.select("doc_id", score.alias("score"), (score >= 3).alias("passes"))


@query("f18_quality_gate", "SELECT doc_id FROM labels WHERE NOT (quality = 0 AND toxic = 1)")
def f18(t):
    return t.labels.where("not (quality = 0 and toxic = 1)").select("doc_id")


@query("x04_usage_signals", r"SELECT doc_id, CAST(regexp_matches(text, '\bthe\b') AS INT) + 1.5 * CAST(regexp_matches(text, 'License') AS INT) + 2 * CAST(regexp_matches(text, '\bof the\b') AS INT) + 0.5 * CAST(regexp_matches(text, '\.\s*The') AS INT) AS weight FROM documents")
def x04(t):
    sign = lambda p: F.col("text").rlike(p).cast("int")
    return t.documents.select("doc_id", (sign(r"\bthe\b") + 1.5 * sign("License") + 2 * sign(r"\bof the\b") + 0.5 * sign(r"\.\s*The")).alias("weight"))


@query("x05_decayed_usage", "SELECT event_id, round(value / 100 + CASE WHEN event_type = 'purchase' THEN 0.5 ELSE 0 END + 0.5 * greatest(0, 1 - (epoch((SELECT max(ts) FROM events)) - epoch(ts)) / 300), 6) AS signal FROM events")
def x05(t):
    asof = F.broadcast(t.events.agg(F.max("ts").alias("asof")))  # one row
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    fresh = 0.5 * F.greatest(F.lit(0.0), 1 - (at("asof") - at("ts")) / 300)
    return t.events.crossJoin(asof).select("event_id", F.round(F.col("value") / 100 + F.when(F.col("event_type") == "purchase", 0.5).otherwise(0.0) + fresh, 6).alias("signal"))


# How a rendered context names what it holds.
CONTEXT_PATTERNS = (r"\[(?:Function|Class|Module|Pattern)\]\s+(\w+)", r"경로:\s*`([^`]+)`", r"##\s+\d+\.\s+\[(?:Function|Class|Module)\]\s+(\w+)", r"호출[자]?:\s*(.+)")
_RENDER = ", r AS (SELECT f.id, '## 1. [Function] ' || replace(name, ' ', '_') || chr(10) || '경로: `' || namespace || '.' || module || '.' || f.id || '`' || chr(10) || '호출: ' || coalesce(o.l, '') AS text FROM functions f LEFT JOIN (SELECT src, array_to_string(list_sort(list(dst))[1:10], ', ') AS l FROM calls GROUP BY 1) o ON o.src = f.id)"


@query("x06_identifier_count", sql(_RENDER + rf""", i AS (SELECT id, list_distinct(list_concat(regexp_extract_all(text, '{CONTEXT_PATTERNS[0]}', 1), list_transform(regexp_extract_all(text, '{CONTEXT_PATTERNS[1]}', 1), lambda p: string_split(p, '.')[-1]),
  regexp_extract_all(text, '{CONTEXT_PATTERNS[2]}', 1), list_filter(flatten(list_transform(regexp_extract_all(text, '{CONTEXT_PATTERNS[3]}', 1), lambda c: list_transform(string_split(c, ','), lambda x: trim(x)))), lambda x: length(x) > 1))) AS names FROM r)
 SELECT id, len(names) AS identifiers, len(list_filter(names, lambda x: contains('red plate', lower(x)) OR contains(lower(x), 'red plate') OR contains(lower(x), 'red') OR contains(lower(x), 'plate'))) AS matched FROM i""", "functions", "calls"))
def x06(t):
    """A function's context as it is rendered, the identifiers that the patterns find in it, and how many the query is near to."""
    low = lambda x, w: F.contains(F.lower(x), F.lit(w))
    near = lambda x: F.contains(F.lit("red plate"), F.lower(x)) | low(x, "red plate") | low(x, "red") | low(x, "plate")
    named = rendered(t).select("id", identifiers("text").alias("names"))
    return named.select("id", F.size("names").alias("identifiers"), F.size(F.filter("names", near)).alias("matched"))


def rendered(t):
    """(id, text, calls): each function's context as a tool shows it, and how many calls it tells."""
    outs = S.capped(t.calls, "src", "dst", 10, "o").withColumnRenamed("src", "id")
    text = F.concat(F.lit("## 1. [Function] "), F.replace("name", F.lit(" "), F.lit("_")), F.lit("\n경로: `"), F.concat_ws(".", "namespace", "module", "id"), F.lit("`\n호출: "), F.coalesce(F.array_join("o", ", "), F.lit("")))
    return t.functions.join(outs, "id", "left").select("id", text.alias("text"), F.coalesce(F.size("o"), F.lit(0)).alias("calls"))


def identifiers(text: str) -> Column:
    """The names that a rendered context holds."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    calls = F.filter(F.flatten(F.transform(found(CONTEXT_PATTERNS[3]), lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x)))), lambda x: F.length(x) > 1)
    paths = F.transform(found(CONTEXT_PATTERNS[1]), lambda p: F.substring_index(p, ".", -1))
    return F.array_distinct(F.concat(found(CONTEXT_PATTERNS[0]), paths, found(CONTEXT_PATTERNS[2]), calls))


@query("x08_timestamp_normalise", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 7200 WHEN event_id % 3 = 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS utc_seconds FROM events")
def x08(t):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("+02:00"))).when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("Z"))).otherwise(base)
    zoned = text.rlike(r"(Z|[+-]\d\d:\d\d)$")  # a time without a zone is rejected
    return t.events.select("event_id", F.when(zoned, F.unix_timestamp(F.try_to_timestamp(text))).alias("utc_seconds"))


#: What a function's signature holds for itself, by its size, and for each function that it calls, by that one's number.
_OWN_PARAMETERS = ("", "self", "limit: number = 5, this", "m: Map<A, Map<B, C>>, k")
_CALLED_PARAMETERS = ("cls", "{}: Record<string, any>", "{}: Array<Map<K, List<V, W>>> = [a]", "{}: int = 10", "{}=None")
# Parameters that a call doesn't pass.
_UNPASSED = ("self", "cls", "this")


def signatures(t):
    """(id, args): the parameter list of each function as it is written."""
    outs = S.capped(t.calls, "src", "dst", 10, "o").withColumnRenamed("src", "id")

    def called(d: Column) -> Column:
        number, out = F.substring(d, 2, 20).cast("long") % len(_CALLED_PARAMETERS), F.lit(_CALLED_PARAMETERS[0])
        for i, form in enumerate(_CALLED_PARAMETERS):
            out = F.when(number == i, F.replace(F.lit(form), F.lit("{}"), d)).otherwise(out)
        return out

    own = F.element_at(X.strings(_OWN_PARAMETERS), F.col("end_line") % len(_OWN_PARAMETERS) + 1)
    parts = F.concat(F.array(own), F.coalesce(F.transform("o", called), F.array().cast("array<string>")))
    return t.functions.join(outs, "id", "left").select("id", F.concat(F.lit("("), F.array_join(F.filter(parts, lambda p: p != ""), ", "), F.lit(")")).alias("args"))


def parameters(args: Column) -> Column:
    """The parameters of a list as (name, type, default). A comma within angle brackets separates nothing: of the pieces between commas,
    the running number of open brackets tells which belong together."""
    pieces = F.split(F.btrim(args, F.lit("()")), ",", -1)
    count = lambda p, c: F.length(p) - F.length(F.replace(p, F.lit(c), F.lit("")))

    def join(s: Column, p: Column) -> Column:
        depth = s["depth"] + count(p, "<") - count(p, ">")
        return F.struct(depth.alias("depth"), F.concat(s["text"], p, F.when(depth == 0, F.lit("\n")).otherwise(F.lit(","))).alias("text"))

    whole = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), join)["text"]
    parts = F.filter(F.transform(F.split(whole, "\n", -1), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin(*_UNPASSED))

    def parsed(p: Column) -> Column:
        colon = F.instr(p, ":") > 0
        rest = F.when(colon, F.regexp_extract(p, "^[^:]*:(.*)$", 1)).otherwise(p)
        equals = F.instr(rest, "=") > 0
        head = F.trim(F.regexp_extract(rest, "^([^=]*)", 1))
        return F.struct(
            F.trim(F.regexp_extract(p, "^([^:=]*)", 1)).alias("name"), F.when(colon, head).otherwise("").alias("type"), F.when(equals, F.trim(F.regexp_extract(rest, "^[^=]*=(.*)$", 1))).alias("default")
        )

    return F.transform(parts, parsed)


_SIGNATURES = ", signatures AS (SELECT f.id, array_to_string(list_filter(list_concat([CASE end_line % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_OWN_PARAMETERS)) + " END], coalesce(list_transform(o.l, lambda d: CASE CAST(substr(d, 2) AS BIGINT) % 5 " + " ".join(f"WHEN {i} THEN replace('{x}', '{{}}', d)" for i, x in enumerate(_CALLED_PARAMETERS)) + " END), [])), lambda p: p <> ''), ', ') AS args FROM functions f LEFT JOIN (SELECT src, list_sort(list(dst))[1:10] AS l FROM calls GROUP BY 1) o ON o.src = f.id)"


@query("x19_parameter_lists", sql(_SIGNATURES + f""", pieces AS (SELECT id, i, p, sum(length(p) - length(replace(p, '<', '')) - length(p) + length(replace(p, '>', ''))) OVER w AS depth FROM (SELECT id, unnest(range(len(l))) AS i, unnest(l) AS p FROM (SELECT id, string_split(args, ',') AS l FROM signatures)) WINDOW w AS (PARTITION BY id ORDER BY i)),
 grouped AS (SELECT *, count(*) FILTER (WHERE depth = 0) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM pieces),
 parts AS (SELECT id, g, trim(string_agg(p, ',' ORDER BY i)) AS p FROM grouped GROUP BY id, g),
 parsed AS (SELECT id, g, trim(regexp_extract(p, '^([^:=]*)', 1)) AS name, CASE WHEN contains(p, ':') THEN trim(regexp_extract(p, '^[^:]*:([^=]*)', 1)) ELSE '' END AS type,
  CASE WHEN contains(p, ':') THEN CASE WHEN contains(regexp_extract(p, '^[^:]*:(.*)$', 1), '=') THEN trim(regexp_extract(p, '^[^:]*:[^=]*=(.*)$', 1)) END WHEN contains(p, '=') THEN trim(regexp_extract(p, '^[^=]*=(.*)$', 1)) END AS preset
  FROM parts WHERE p NOT IN ('', {", ".join(f"'{x}'" for x in _UNPASSED)}))
 SELECT s.id, count(g) AS parameters, count(g) FILTER (WHERE type <> '') AS typed, count(preset) AS preset, coalesce(string_agg(name || ':' || type, ';' ORDER BY g), '') AS names FROM signatures s LEFT JOIN parsed p USING (id) GROUP BY s.id""", "functions", "calls"))
def x19(t):
    rows = signatures(t).select("id", parameters(F.col("args")).alias("p"))
    size = lambda keep: F.size(F.filter("p", keep)).cast("long")
    return rows.select(
        "id", F.size("p").cast("long").alias("parameters"), size(lambda p: p["type"] != "").alias("typed"), size(lambda p: p["default"].isNotNull()).alias("preset"),
        F.array_join(F.transform("p", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ";").alias("names"),
    )


@query("x21_response_parsing", "SELECT event_id, least(5, greatest(1, k)) AS score FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)")
def x21(t):
    wrapped = F.concat(F.lit("Result: "), F.col("props"), F.lit(" done"))
    whole = F.from_json(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(wrapped), "k int", {"mode": "PERMISSIVE"})["k"]
    inner = F.from_json(F.regexp_extract(wrapped, r"(\{.*\})", 1), "k int")["k"]
    digits = F.regexp_extract(wrapped, r"(\d+)", 1).try_cast("int")
    return t.events.select("event_id", F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(whole, inner, digits))).alias("score"))


@query("x25_command_parse", r"SELECT conv_id, turn, regexp_extract(text, '^([A-Za-z]+)', 1) AS command FROM conversations WHERE regexp_matches(text, '^[A-Za-z]+ ')")
def x25(t):
    return t.conversations.where(F.col("text").rlike("^[A-Za-z]+ ")).select("conv_id", "turn", F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("command"))


@query("p01_page_ingest", r"SELECT page_id, 'heading' AS kind, unnest(regexp_extract_all(html, '<h[1-6]>([^<]*)<', 1)) AS name FROM pages UNION ALL SELECT page_id, 'link', unnest(regexp_extract_all(html, '<a href=.([^>]*).>', 1)) FROM pages")
def p01(t):
    each = lambda kind, p: t.pages.select("page_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit(p), 1)).alias("name"))
    return each("heading", "<h[1-6]>([^<]*)<").unionByName(each("link", "<a href=.([^>]*).>"))


_LINKS = r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=.([^>]*).>', 1))) AS name FROM pages"


@query("p02_sync_pages", f"WITH new AS ({_LINKS}), old AS (SELECT page_id, name FROM new WHERE length(name) % 2 = 0 UNION ALL SELECT DISTINCT page_id, 'gone' FROM new WHERE page_id % 5 = 0), j AS (SELECT coalesce(n.page_id, o.page_id) AS page_id, n.name AS n, o.name AS o FROM new n FULL JOIN old o ON n.page_id = o.page_id AND n.name = o.name) SELECT page_id, count(n) AS stored, count(*) FILTER (WHERE o IS NULL) AS added, count(*) FILTER (WHERE n IS NULL) AS removed, CASE WHEN count(*) FILTER (WHERE o IS NULL OR n IS NULL) > 0 THEN 2 ELSE 1 END AS version FROM j GROUP BY page_id")
def p02(t):
    """A page's new entities are upserted, those gone from it removed, and the change is logged with a new version."""
    new = stored(p01(t).where("kind = 'link'").select("page_id", "name").distinct())
    gone = new.where("page_id % 5 = 0").select("page_id", F.lit("gone").alias("name")).distinct()
    old = new.where("length(name) % 2 = 0").unionByName(gone)
    both = new.withColumn("n", F.lit(1)).join(old.withColumn("o", F.lit(1)), ["page_id", "name"], "full_outer")
    added, removed = F.count_if(F.col("o").isNull()), F.count_if(F.col("n").isNull())
    return both.groupBy("page_id").agg(F.count("n").alias("stored"), added.alias("added"), removed.alias("removed"), F.when(added + removed > 0, 2).otherwise(1).alias("version"))


@query("p03_project_index", r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS project, count(*) AS files, sum(length(html)) AS chars FROM pages GROUP BY 1")
def p03(t):
    return t.pages.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("project")).agg(F.count("*").alias("files"), F.sum(F.length("html")).alias("chars"))


#: Words of an item that it is looked up by, and results of a ranked method.
_ASKED_WORDS, _TOP = 8, 5
#: Characters that short passages are looked up by, and candidates that a broadcast may have; neither changes what is found.
_GRAM, _HELD = 16, 200_000


def holders(t):
    """(query, key): the documents that hold an item's passage as it is. Some inner words of the item, which a document that holds it has
    one after the other, are joined with such runs of the documents' words; a short item's first characters with as many of the documents' from
    any place on. What they find is compared as a whole."""
    run = 8
    words = lambda c: X.tokens(F.col(c))
    # the first and last word may be part of a longer one in a document
    items = t.benchmark.select(F.col("item_id").cast("string").alias("query"), F.col("text").alias("passage"), words("text").alias("w")).where("passage is not null")
    long = items.where(F.size("w") >= run + 2).select("query", "passage", F.array_join(F.slice("w", 2, run), " ").alias("run"))
    texts = t.documents.select(F.col("doc_id").alias("key"), words("text").alias("w")).where(F.size("w") >= run)
    runs = texts.select("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - run + 1), lambda i: F.array_join(F.slice("w", i, run), " ")))).alias("run"))
    near = runs.join(long, "run").select("query", "passage", "key")
    short = items.where(F.size("w") < run + 2).select("query", "passage", F.substring("passage", 1, _GRAM).alias("gram"))
    for n in sorted(r.n for r in short.select(F.length("gram").alias("n")).distinct().collect()):  # ``_GRAM`` + 1 at most
        letters = t.documents.where("text is not null").select(F.col("doc_id").alias("key"), F.split("text", "").alias("c")).where(F.size("c") >= n)
        grams = letters.select("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("c") - n + 1), lambda i: F.array_join(F.slice("c", i, n), "")))).alias("gram"))  # noqa: B023
        near = near.unionByName(grams.join(short.where(F.length("gram") == n), "gram").select("query", "passage", "key"))
    near = stored(near.distinct())
    if near.count() > _HELD:  # else few, so that they go to the texts
        near = near.hint("merge")
    found = near.join(t.documents.select(F.col("doc_id").alias("key"), "text"), "key").where(F.contains("text", F.col("passage"))).select("query", "key")
    return found.distinct()


_BENCH = f""", items AS (SELECT CAST(item_id AS VARCHAR) AS query, text AS passage, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) AS w FROM benchmark),
asked AS (SELECT DISTINCT query, unnest(list_filter(w, lambda x: length(x) > 1 AND x NOT IN ({", ".join(f"'{x}'" for x in X.STOPWORDS)}))[1:{_ASKED_WORDS}]) AS term FROM items),
post AS (SELECT doc_id, term, count(*) AS tf, dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1) AS w FROM documents)) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1))) AS avgdl FROM documents),
df AS (SELECT term, count(*) AS d FROM post GROUP BY term),
scored AS (SELECT query, doc_id, count(*) AS words, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN post USING (term) JOIN df USING (term), stats GROUP BY query, doc_id),
relevant AS (SELECT query, doc_id FROM items JOIN documents ON contains(text, passage)),
ranked AS (SELECT 'keywords' AS method, query, doc_id, row_number() OVER (PARTITION BY query ORDER BY words DESC, doc_id) AS rn FROM scored
 UNION ALL SELECT * FROM (SELECT 'bm25', query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rn FROM scored) WHERE rn <= {_TOP}),
sums AS (SELECT method, r.query, count(*) AS found, count(v.doc_id) AS hits, coalesce(1.0 / min(CASE WHEN v.doc_id IS NOT NULL AND rn <= {_TOP} THEN rn END), 0) AS mrr, coalesce(sum(CASE WHEN v.doc_id IS NOT NULL AND rn <= {_TOP} THEN 1 / log2(rn + 1) END), 0) AS dcg
 FROM ranked r LEFT JOIN relevant v ON v.query = r.query AND v.doc_id = r.doc_id GROUP BY ALL),
want AS (SELECT query, count(*) AS expected FROM relevant GROUP BY query)
SELECT method, query, found, hits, round(hits / greatest(found, 1), 4) AS precision, round(hits / greatest(coalesce(expected, 0), 1), 4) AS recall, round(mrr, 4) AS mrr,
 round(dcg / CASE least(coalesce(expected, 0), {_TOP}) {" ".join(f"WHEN {i} THEN {sum(1 / math.log2(k + 1) for k in range(1, i + 1))}" for i in range(1, _TOP + 1))} ELSE 1 END, 4) AS ndcg
FROM sums LEFT JOIN want USING (query)"""


@query("p25_retrieval_benchmark", sql(_BENCH))
def p25(t):
    """Every benchmark item asked of all documents at once, by two methods: all that have one of its keywords, in the order of how many, and
    the five best of the full-text index. Relevant are the documents that hold the item's passage."""
    asked = t.benchmark.select(F.col("item_id").cast("string").alias("query"), F.explode(F.array_distinct(X.keywords(F.col("text"), _ASKED_WORDS))).alias("term"))
    asked = stored(asked)
    index = t.fulltext
    many = index.matches(asked)
    top = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("words"), "key"))
    first = many.withColumn("rank", top).where(F.col("rank") <= _TOP).select("query", "key", "rank")
    relevant = stored(holders(t))
    expected = relevant.groupBy("query").agg(F.count("*").alias("expected"))

    def judged(method, found, ranked):
        """``found`` has all results, or is ``ranked`` itself."""
        hits = found.join(relevant.withColumn("hit", F.lit(1)), ["query", "key"], "left").groupBy("query").agg(F.count("*").alias("found"), F.count("hit").alias("hits"))
        good = ranked.join(relevant, ["query", "key"], "left_semi").groupBy("query").agg((1.0 / F.min("rank")).alias("mrr"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
        return hits.join(good, "query", "left").withColumn("method", F.lit(method))

    best = stored(index.search(asked, _TOP).select("query", "key", "rank"))
    every = judged("keywords", many.select("query", "key"), first).unionByName(judged("bm25", best, best)).join(expected, "query", "left")
    want = F.coalesce("expected", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(want, F.lit(_TOP)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    share = lambda of: F.round(F.col("hits") / F.greatest(of, F.lit(1)), 4)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "method", "query", "found", "hits", share(F.col("found")).alias("precision"), share(want).alias("recall"), F.round(zero("mrr"), 4).alias("mrr"), F.round(zero("dcg") / ideal, 4).alias("ndcg")
    )


@query("m27_append_log", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def m27(t):
    """Appended JSON lines read back; each append adds files, none is rewritten."""
    path = folder(t.spark)
    for half in (0, 1):
        t.events.where(F.col("event_id") % 2 == half).select("event_id", "event_type").write.mode("append").json(path)
    return t.spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("m28_atomic_snapshot", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def m28(t):
    """A snapshot appears under its name only when the writer has committed all of it."""
    path = folder(t.spark)
    t.documents.groupBy("lang").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


