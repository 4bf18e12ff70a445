"""SQL (DuckDB) for the column functions, built from the same vocabularies; used to check the queries."""

from __future__ import annotations

from potluck.functions import vocab as v


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(entries: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in entries) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


#: A title between marks and a link, which leave nothing but blanks.
TITLE_MARKS = "string_split(text, chr(10))[1]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {strip('s')}), lambda s: s <> '')"


def re2(pattern: str) -> str:
    """A pattern without look-ahead for RE2; word edges count every letter and digit."""
    return pattern.replace("(?iU)", "").replace("(?U)", "")


def search(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + edges(pattern))})"


def edges(pattern: str) -> str:
    """\\b as RE2 sees it counts ASCII only; where a pattern ends in one, ask for no letter after it instead."""
    return pattern.replace(r"s?\b", r"s?(?:[^\p{L}\p{N}_]|$)").replace(r")\b", r")(?:[^\p{L}\p{N}_]|$)").replace(r"\b\d", r"(?:^|[^\p{L}\p{N}_])\d")


def hits(x: str, entries: list[str]) -> str:
    return f"len(list_filter({array(entries)}, lambda w: contains({x}, w)))"


def any_of(x: str, entries: list[str]) -> str:
    return f"({hits(x, entries)} > 0)"


def count_if(xs: str, test: str) -> str:
    return f"len(list_filter({xs}, lambda x: {test}))"


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / ({whole}) ELSE 0.0 END)"


def whole_words(x: str, entries: list[str]) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains({array(entries)}, w)))"


def trailing_words(x: str, entries: list[str], marks: str) -> str:
    return f"len(list_filter({words(x)}, lambda w: list_contains({array(entries)}, rtrim(w, {q(marks)}))))"


def steps(x: str, cuts: list[tuple], otherwise: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} >= {a} THEN {b}" for a, b in cuts) + f" ELSE {otherwise} END)"


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def guard(x: str, least: int, score: str) -> str:
    return f"(CASE WHEN length({strip(f'coalesce({x}, {q(str())})')}) >= {least} THEN {score} ELSE 0.0 END)"


def ingredient_points(t: str, ls: str) -> str:
    structured = "regexp_matches(x, '^[-*\\d]+[.)]\\s')"
    ratio = share(count_if(ls, structured), f"len({ls})")
    return (
        f"(CASE WHEN length({t}) > 0 THEN least(45, {steps(f'length({t})', [(300, 15), (200, 12), (100, 9), (50, 6)], '3')} + "
        f"{steps(ratio, [(0.7, 15), (0.4, 10), (0.2, 5)], '0')} + {steps(count_if(ls, 'length(x) > 5'), [(10, 10), (7, 8), (5, 6), (3, 4), (1, 2)], '0')} + "
        f"(CASE WHEN regexp_matches({t}, {q('(?i)' + v.SCORE_MEASUREMENT)}) THEN 5 ELSE 0 END)) ELSE 0 END)"
    )


def instruction_points(t: str, low: str, ls: str) -> str:
    ends = f"(length({t}) - length(translate({t}, '.!?', '')))"
    numbered = count_if(ls, "regexp_matches(x, '^\\d+[.)]\\s')")
    return (
        f"(CASE WHEN length({t}) > 0 THEN least(45, {steps(f'length({t})', [(500, 15), (300, 12), (200, 9), (100, 6)], '3')} + "
        f"{steps(numbered, [(5, 15), (3, 12), (2, 8)], '0')} + {steps(hits(low, v.SCORE_VERBS), [(8, 10), (5, 8), (3, 5), (1, 3)], '0')} + "
        f"{steps(ends, [(5, 5), (3, 3), (1, 1)], '0')}) ELSE 0 END)"
    )


def method(low: str) -> str:
    return "(CASE " + " ".join(f"WHEN {any_of(low, ws)} THEN {q(m)}" for m, ws in v.METHODS) + " END)"


def protein(low: str) -> str:
    return "(CASE " + " ".join(f"WHEN contains({low}, {q(p)}) THEN {q(p)}" for p in v.PROTEINS) + " END)"


def quality(ingredients: str, instructions: str, total: str, text: str, method_: str, protein_: str) -> str:
    short = lambda n: f"(CASE WHEN length({strip(f'coalesce({text}, {q(str())})')}) < {n} THEN 40 ELSE 0 END)"
    meta = f"(CASE WHEN {method_} IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN {protein_} IS NOT NULL THEN 1 ELSE 0 END)"
    return f"least(100, greatest(0, {ingredients} + {instructions} + {meta} - {short(10)} - {short(20)}))::INTEGER"


def mean_length(ls: str) -> str:
    return f"(list_sum(list_transform({ls}, lambda x: length(x)))::DOUBLE / len({ls}))"


def falling(x: str, lo: float, hi: float, end: float, slope: float, below: str) -> str:
    return f"(CASE WHEN {x} BETWEEN {lo} AND {hi} THEN 1.0 WHEN {x} < {lo} THEN {below} WHEN {x} > {hi} AND {x} <= {end} THEN 1.0 - ({x} - {hi}) / {slope} ELSE 0.0 END)"


def density(low: str, entries: list[str]) -> str:
    return f"({share(hits(low, entries), f'length({low})')} * 100)"


def per_words(low: str, entries: list[str], per: int, marks: str = ",.;:!?") -> str:
    return f"({share(trailing_words(low, entries, marks), f'len({words(low)})')} * {per})"


# Each dict gives the steps of a query: (columns of the first level, columns over them). A level keeps
# every subexpression that several parts need.

INGREDIENT_BASE = {
    "m_ratio": share(count_if("ls", f"({search('x', v.UNIT_LINE)} OR regexp_matches(x, {q(v.FRACTION)}))"), "len(ls)"),
    "noun_d": density("low", v.NOUNS),
    "desc_d": density("low", v.DESCRIPTORS),
    "mean": f"(CASE WHEN len(ls) > 0 THEN {mean_length('ls')} END)",
    "markers": share(count_if("ls", f"regexp_matches(x, {q(v.LIST_MARKER)})"), "len(ls)"),
    "ideal": share(count_if("ls", "length(x) BETWEEN 20 AND 100"), "len(ls)"),
    "penalties": "list_sum(list_transform("
    + array([f" {w} " for w in v.INGREDIENT_VERBS])
    + ", lambda w: (length(low) - length(replace(low, w, ''))) // length(w)))",
}
INGREDIENT_PARTS = {
    "measurement": steps("m_ratio", [(0.7, 1.0), (0.5, 0.85), (0.3, 0.65), (0.15, 0.4)], "m_ratio * 2"),
    "nouns": steps("noun_d", [(3.0, 1.0), (2.0, 0.85), (1.0, 0.65), (0.5, 0.45)], "noun_d"),
    "descriptors": steps("desc_d", [(2.0, 1.0), (1.0, 0.75), (0.5, 0.5)], "desc_d * 0.5"),
    "list_structure": "(CASE WHEN len(ls) < 3 THEN 0.0 ELSE least(markers * 0.6 + (1.0 - least(list_sum(list_transform(ls, lambda x: abs(length(x) - mean))) / len(ls) / 50, 1.0)) * 0.4, 1.0) END)",
    "line_length": "(CASE WHEN len(ls) = 0 THEN 0.0 ELSE ideal * 0.6 + (CASE WHEN mean BETWEEN 40 AND 70 THEN 1.0 WHEN mean BETWEEN 30 AND 80 THEN 0.75 ELSE 0.5 END) * 0.4 END)",
    "verb_absence": "(CASE penalties WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0.0 END)",
}
INGREDIENT_SCORE = guard(
    "text", 10, clamp("measurement * 0.30 + nouns * 0.25 + descriptors * 0.15 + list_structure * 0.15 + line_length * 0.10 + verb_absence * 0.05")
)

INSTRUCTION_BASE = {
    "verb_d": f"({share(whole_words('low', v.COOKING_VERBS), f'len({words(chr(108) + chr(111) + chr(119))})')} * 100)",
    "markers": f"least({hits('low', sorted({*v.TEMPORAL, *v.SEQUENTIAL}))} / 3.0::DOUBLE, 1.0)",
    "imperative": share(
        f"len(list_filter(ss, lambda s: list_contains({array(v.IMPERATIVES)}, rtrim(regexp_split_to_array(s, '\\s+')[1], ',.:;'))))", "len(ss)"
    ),
    "n": "length(text)",
    "m_ratio": share(count_if("ls", search("x", v.MEASUREMENT)), "len(ls)"),
}
INSTRUCTION_PARTS = {
    "verb_density": "(CASE WHEN verb_d BETWEEN 10 AND 40 THEN 1.0 WHEN verb_d >= 5 AND verb_d < 10 THEN (verb_d - 5) / 5 WHEN verb_d > 40 AND verb_d <= 60 THEN 1.0 - (verb_d - 40) / 20 WHEN verb_d >= 60 THEN 0.3 ELSE 0.0 END)",
    "paragraph": "(CASE WHEN n BETWEEN 100 AND 500 THEN 1.0 WHEN n >= 50 AND n < 100 THEN (n - 50) / 50.0::DOUBLE WHEN n > 500 AND n <= 1000 THEN 1.0 - (n - 500) / 500.0::DOUBLE ELSE 0.0 END)",
    "measurement": "(CASE WHEN m_ratio < 0.2 THEN 1.0 WHEN m_ratio > 0.5 THEN 0.0 ELSE 1.0 - (m_ratio - 0.2) / 0.3 END)",
}
INSTRUCTION_SCORE = guard("text", 10, clamp("verb_density * 0.30 + markers * 0.25 + imperative * 0.20 + paragraph * 0.15 + measurement * 0.10"))

LINGUISTIC_BASE = {
    "i_verbs": per_words("low", v.LING_VERBS, 100),
    "i_temporal": f"least({hits('low', v.LING_TEMPORAL)} / 2.0::DOUBLE, 1.0)",
    "s_mean": f"(CASE WHEN len(ss) > 0 THEN {mean_length('ss')} END)",
    "stops": hits("low", v.LING_STOPS),
    "starts": f"(len(list_filter({array(v.LING_STOPS)}, lambda w: starts_with({strip('low')}, w))) > 0)",
    "m_words": per_words("low", v.META_WORDS, 10),
    "digits": "len(regexp_extract_all(low, '[0-9]'))",
    "unit": f"regexp_matches(low, {q(edges(v.TIME_UNIT))})",
    "ranges": "regexp_matches(low, '\\d+\\s*[-to]\\s*\\d+')",
    "narrative": share(trailing_words("low", v.NARRATIVE, ",.;:!?"), f"len({words('low')})"),
    "g_desc": per_words("low", v.LING_DESCRIPTORS, 20),
    "g_unit": per_words("low", v.LING_UNITS, 10, ",.;:!?s"),
    "g_nouns": density("low", v.LING_NOUNS),
    "g_verbs": hits("(' ' || low || ' ')", [f" {w} " for w in v.INGREDIENT_VERBS]),
    "g_ideal": share(count_if("ls", "length(x) BETWEEN 20 AND 100"), "len(ls)"),
    "g_marks": share(count_if("ls", f"regexp_matches(x, {q(v.LING_MARKER)})"), "len(ls)"),
}
LINGUISTIC_SCORES = {
    "instruction_score": guard(
        "text",
        10,
        clamp(
            f"{falling('i_verbs', 2, 8, 12, 8.0, 'i_verbs / 2')} * 0.4 + i_temporal * 0.3 + (CASE WHEN s_mean IS NULL THEN 0.0 ELSE "
            f"{falling('s_mean', 40, 150, 250, 100.0, '(CASE WHEN s_mean >= 20 THEN (s_mean - 20) / 20 ELSE 0.0 END)')} END) * 0.2 + "
            "(CASE WHEN starts THEN 0.0 WHEN stops = 0 THEN 1.0 WHEN stops = 1 THEN 0.5 ELSE 0.0 END) * 0.1"
        ),
    ),
    "metadata_score": guard(
        "text",
        3,
        clamp(
            f"{falling('m_words', 1, 3, 5, 4.0, 'm_words')} * 0.35 + least((CASE WHEN digits > 8 THEN 0.2 WHEN digits >= 1 THEN 0.4 ELSE 0.0 END) + (CASE WHEN unit THEN 0.3 ELSE 0.0 END) + "
            f"(CASE WHEN ranges THEN 0.3 ELSE 0.0 END), 1.0) * 0.30 + {falling('length(text)', 5, 100, 200, 100.0, 'length(text) / 5.0::DOUBLE')} * 0.20 + "
            "(CASE WHEN narrative < 0.1 THEN 1.0 WHEN narrative < 0.3 THEN 1.0 - (narrative - 0.1) / 0.2 ELSE 0.0 END) * 0.15"
        ),
    ),
    "ingredient_score": guard(
        "text",
        10,
        clamp(
            f"{falling('g_desc', 1, 4, 6, 4.0, 'g_desc')} * 0.30 + {falling('g_unit', 0.5, 3, 5, 4.0, 'g_unit / 0.5')} * 0.25 + "
            "least(g_ideal * 0.4 + g_marks * 0.3 + (CASE WHEN len(ls) >= 3 THEN 0.3 WHEN len(ls) = 2 THEN 0.15 ELSE 0.0 END), 1.0) * 0.20 + "
            f"{steps('g_nouns', [(2.0, 1.0), (1.0, 0.75), (0.5, 0.5)], 'g_nouns')} * 0.15 + (CASE g_verbs WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.0 END) * 0.10"
        ),
    ),
}

LEGACY_BASE = {
    "mean": f"(CASE WHEN len(ls) > 0 THEN {mean_length('ls')} END)",
    "verb_r": share(count_if("ls", any_of("x", v.LEGACY_LINE_VERBS)), "len(ls)"),
    "desc_r": share(count_if("ls", any_of("x", v.LEGACY_DESCRIPTORS)), "len(ls)"),
    "list_r": share(count_if("ls", "regexp_matches(x, '^[\\d•\\-*]\\s*[\\p{L}\\p{N}_]+')"), "len(ls)"),
    "unit_r": share(count_if("ls", any_of("x", v.LEGACY_UNITS)), "len(ls)"),
    "word_r": share(count_if("ls", any_of("x", v.LEGACY_KEYWORDS)), "len(ls)"),
    "digit_r": share(count_if("ls", "regexp_matches(x, '\\d')"), "len(ls)"),
}
LEGACY_SCORES = {
    "legacy_linguistic": guard(
        "text",
        10,
        clamp("(CASE WHEN verb_r > 0.5 THEN -0.3 ELSE 0.0 END) + desc_r * 0.4 + (CASE WHEN mean BETWEEN 20 AND 80 THEN 0.3 WHEN mean > 150 THEN -0.2 ELSE 0.0 END) + list_r * 0.3 + 0.5"),
    ),
    "legacy_pattern": guard("text", 10, "least(unit_r * 0.4 + word_r * 0.3 + digit_r * 0.3, 1.0)"),
}


def confidence(low: str, field: str) -> str:
    """Of lower-cased text, by kind of field."""
    short = lambda lo, hi: f"(CASE WHEN length({low}) BETWEEN {lo} AND {hi} THEN 0.1 ELSE 0.0 END)"
    below = lambda n, w: f"(CASE WHEN length({low}) < {n} THEN {w} ELSE 0.0 END)"
    number, unit = f"regexp_matches({low}, '(?:^|[^\\p{{L}}\\p{{N}}_])\\d+(?:[^\\p{{L}}\\p{{N}}_]|$)')", f"regexp_matches({low}, {q(edges(v.TIME_UNIT))})"
    if field == "servings":
        score = (
            f"least({hits(low, v.SERVING_WORDS)} / 2.0::DOUBLE, 1.0) * 0.4 + (CASE WHEN regexp_matches({low}, {q(v.SERVING_NUMBER)}) THEN 0.3 "
            f"WHEN regexp_matches({low}, {q(v.SERVES)}) THEN 0.2 ELSE 0.0 END) + (CASE WHEN {number} THEN 0.2 ELSE 0.0 END) + {short(5, 50)}"
        )
        return f"least({score}, 1.0)"
    if field == "time":
        # the look-ahead always ends: at a line's end at the latest
        prep = v.PREP_TIME.replace(r"+?)(?=\n|cook|$)", r")") + r"[^.\n]*(?:\n|cook|$)"
        cook = v.COOK_TIME.replace(r"+?)(?=\n|prep|$)", r")") + r"[^.\n]*(?:\n|prep|$)"
        score = (
            f"least({hits(low, v.TIME_WORDS)} / 2.0::DOUBLE, 1.0) * 0.4 + (CASE WHEN regexp_matches({low}, {q(prep)}) OR regexp_matches({low}, {q(cook)}) THEN 0.3 "
            f"WHEN {unit} THEN 0.15 ELSE 0.0 END) + (CASE WHEN {number} AND {unit} THEN 0.2 ELSE 0.0 END) + {short(5, 60)}"
        )
        return f"least({score}, 1.0)"
    if field == "method":
        found = " + ".join(f"(CASE WHEN {any_of(low, ws)} THEN 1 ELSE 0 END)" for _, ws in v.METHODS)
        return clamp(f"least(0.7, ({found}) * 0.35) + {below(100, 0.2)} - (CASE WHEN length({low}) > 200 OR {any_of(low, v.METHOD_UNITS)} THEN 0.1 ELSE 0.0 END)")
    if field == "protein":
        n = hits(low, v.PROTEINS)
        return f"least((CASE WHEN {n} = 1 THEN 0.7 WHEN {n} > 1 THEN 0.4 ELSE 0.0 END) + {below(100, 0.2)} + (CASE WHEN {any_of(low, v.PROTEIN_CONTEXT)} THEN 0.1 ELSE 0.0 END), 1.0)"
    n = hits(low, [w for w, _ in v.DIFFICULTY])
    return f"least(least(0.6, {n} * 0.3) + {below(80, 0.3)} + (CASE WHEN {any_of(low, v.DIFFICULTY_CONTEXT)} THEN 0.1 ELSE 0.0 END), 1.0)"


def levels(base: dict[str, str], parts: dict[str, str], out: dict[str, str], source: str = "documents") -> str:
    """SELECT doc_id and the outputs, rounded, over texts with their lower case, lines and sentences."""
    pick = lambda d: "".join(f", {x}::DOUBLE AS {n}" if n not in ("starts", "unit", "ranges") else f", {x} AS {n}" for n, x in d.items())
    rounded = ", ".join(f"round(({x})::DOUBLE, 6) AS {n}" for n, x in out.items())
    return (
        f"WITH t AS MATERIALIZED (SELECT doc_id, text, lower(text) AS low, {lines('text')} AS ls, {sentences('lower(text)')} AS ss FROM {source}), "
        f"b AS MATERIALIZED (SELECT *{pick(base)} FROM t), p AS MATERIALIZED (SELECT *{pick(parts)} FROM b) SELECT doc_id, {rounded} FROM p"
    )
