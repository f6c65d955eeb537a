"""English stems by the published Snowball rules (Porter 2), as SQL expressions over a column of lower-case words.

Each step is a text that Spark's SQL and DuckDB's both read, over the columns ``s`` (the word so far), ``p1`` and ``p2`` (how many
characters stand before the regions R1 and R2). Words of one or two characters stay as they are. Apostrophes aren't expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed values of the published rules: words with stems of their own, words that stay, words that stop after the first step.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
STOPPED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
# Suffixes and what stands for them, of the second, third and fourth step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
# Words that say too little to be searched for.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

_V, _N = "[aeiouy]", "[^aeiouy]"
_SHORT = f"(^{_V}{_N}|{_N}{_V}[^aeiouywxY])$"


def _less(n: int, end: str = "") -> str:
    cut = f"left(s, length(s) - {n})"
    return f"concat({cut}, '{end}')" if end else cut


def _within(suffix: str, region: str, then: str) -> str:
    """``then`` if the suffix lies within the region, else the word."""
    return f"CASE WHEN length(s) - {len(suffix)} >= {region} THEN {then} ELSE s END"


def _longest(rules: dict[str, str]) -> str:
    """The rule of the longest suffix that the word has."""
    return "CASE " + " ".join(f"WHEN s LIKE '%{x}' THEN {rules[x]}" for x in sorted(rules, key=lambda x: (-len(x), x))) + " ELSE s END"


def _removed(suffix: str) -> str:
    """Suffixes like ``ing`` go if a vowel stands before them; what is left is marked for the mending that follows."""
    return f"CASE WHEN regexp_like({_less(len(suffix))}, '{_V}') THEN concat({_less(len(suffix))}, '+') ELSE s END"


_PLURAL = f"CASE WHEN s LIKE '%sses' THEN {_less(2)} WHEN s LIKE '%ied' OR s LIKE '%ies' THEN CASE WHEN length(s) > 4 THEN {_less(2)} ELSE {_less(1)} END WHEN s LIKE '%us' OR s LIKE '%ss' THEN s WHEN regexp_like(s, '{_V}.+s$') THEN {_less(1)} ELSE s END"
_PAST = _longest({"eedly": _within("eedly", "p1", _less(3)), "eed": _within("eed", "p1", _less(1)), **{x: _removed(x) for x in ("ed", "edly", "ing", "ingly")}})
_MENDED = (
    f"CASE WHEN s NOT LIKE '%+' THEN s WHEN s LIKE '%at+' OR s LIKE '%bl+' OR s LIKE '%iz+' THEN {_less(1, 'e')} WHEN regexp_like(s, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)[+]$') THEN {_less(2)} "
    f"WHEN p1 >= length(s) - 1 AND regexp_like({_less(1)}, '{_SHORT}') THEN {_less(1, 'e')} ELSE {_less(1)} END"
)
_ENDING_Y = f"CASE WHEN regexp_like(s, '.{_N}[yY]$') THEN {_less(1, 'i')} ELSE s END"
_SECOND = _longest({**{x: _within(x, "p1", _less(len(x), y)) for x, y in SECOND.items()}, "ogi": f"CASE WHEN s LIKE '%logi' THEN {_within('ogi', 'p1', _less(1))} ELSE s END", "li": f"CASE WHEN regexp_like(s, '[cdeghkmnrt]li$') THEN {_within('li', 'p1', _less(2))} ELSE s END"})
_THIRD = _longest({**{x: _within(x, "p1", _less(len(x), y)) for x, y in THIRD.items()}, "ative": _within("ative", "p2", _less(5))})
_FOURTH = _longest({**{x: _within(x, "p2", _less(len(x))) for x in FOURTH}, "ion": f"CASE WHEN regexp_like(s, '[st]ion$') THEN {_within('ion', 'p2', _less(3))} ELSE s END"})
_LAST = (
    f"CASE WHEN s LIKE '%e' THEN CASE WHEN length(s) - 1 >= p2 OR (length(s) - 1 >= p1 AND NOT regexp_like({_less(1)}, '{_SHORT}')) THEN {_less(1)} ELSE s END "
    f"WHEN s LIKE '%ll' AND length(s) - 1 >= p2 THEN {_less(1)} ELSE s END"
)
_FIRST_REGION = f"^(gener|commun|arsen)|^.*?{_V}{_N}"


def steps(word: str) -> list[dict[str, str]]:
    """Projections on end, each from a name to its expression; ``word`` names the column of words, ``stem`` is in the last one."""
    keep = {"w": "w", "s": "s", "p1": "p1", "p2": "p2"}
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    return [
        {"w": word, "s": f"regexp_replace({word}, '^y', 'Y')"},
        {"w": "w", "s": f"regexp_replace(s, '({_V})y', '{{one}}Y'{{all}})"},
        {"w": "w", "s": "s", "r": f"regexp_extract(s, '{_FIRST_REGION}', 0)"},
        {"w": "w", "s": "s", "p1": "CASE WHEN r = '' THEN length(s) ELSE length(r) END"},
        {"w": "w", "s": "s", "p1": "p1", "r": f"regexp_extract(substring(s, p1 + 1), '^.*?{_V}{_N}', 0)"},
        {"w": "w", "s": "s", "p1": "p1", "p2": "CASE WHEN r = '' THEN length(s) ELSE p1 + length(r) END"},
        keep | {"s": _PLURAL},
        keep | {"s": f"CASE WHEN s IN ({listed(STOPPED)}) THEN s ELSE {_PAST} END"},
        keep | {"s": _MENDED},
        *[keep | {"s": f"CASE WHEN s IN ({listed(STOPPED)}) THEN s ELSE {x} END"} for x in (_ENDING_Y, _SECOND, _THIRD, _FOURTH, _LAST)],
        {"w": "w", "stem": f"CASE WHEN length(w) <= 2 OR w IN ({listed(INVARIANT)}) THEN w ELSE CASE w {own} ELSE replace(s, 'Y', 'y') END END"},
    ]


def with_stem(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Add ``stem`` to every row, in place of a column of that name. Null words have null stems. Meant for distinct words, as each row is stemmed anew."""
    others = [c for c in words.columns if c != "stem"]
    found = words.selectExpr(f"`{word_col}` AS w", f"struct({', '.join(f'`{c}`' for c in others)}) AS rest")
    for step in steps("w"):
        found = found.selectExpr("rest", *[f"{e.format(one='$1', all='')} AS {name}" if "{one}" in e else f"{e} AS {name}" for name, e in step.items()])
    return found.select(*[f"rest.`{c}`" for c in others], "stem")


def stem_sql(table: str, word: str = "word") -> str:
    """DuckDB's SQL for the distinct words of ``table`` with their stems: w, stem."""
    sql = f"SELECT DISTINCT {word} FROM {table}"
    for step in steps(word):
        shown = [(e.format(one="\\1", all=", 'g'") if "{one}" in e else e).replace("regexp_like(", "regexp_matches(") for e in step.values()]
        sql = f"SELECT {', '.join(f'{e} AS {name}' for e, name in zip(shown, step, strict=True))} FROM ({sql})"
    return sql
