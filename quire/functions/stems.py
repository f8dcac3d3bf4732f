"""English stems by suffixes, as column expressions.

The rules are those of the Porter2 algorithm, step by step. A step is an expression over the
columns w (the word so far, with y written Y where it is a consonant), r1 and r2 (where the
regions after the first and the second vowel-consonant pair begin). The expressions are written
in the SQL that Spark and ANSI engines share, so that the same steps can be run elsewhere.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

# Words that don't follow the rules, beginnings that are a whole first region, and what stays once plurals are off.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
WHOLE_R1 = ["gener", "commun", "arsen"]
# Endings and what stands in their place, in the first region; in the second region.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
DOUBLE, VALID_LI = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"], "[cdeghkmnrt]"

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = f"^{_C}*{_V}+{_C}"
_SHORT_END = f"(?:^{_V}{_C}|{_C}{_V}[^aeiouywxY])$"


def _found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, '{pattern}', {group})"


def _has(x: str, pattern: str) -> str:
    return f"{_found(x, pattern)} <> ''"


def _ending(endings) -> str:
    """The longest of these endings that w has, or the empty string."""
    return _found("w", f"(?:{'|'.join(endings)})$")


def _cut(n: str) -> str:
    return f"left(w, length(w) - {n})"


def _listed(words) -> str:
    return ", ".join(f"'{x}'" for x in words)


def _case(x: str, pairs: dict[str, str]) -> str:
    return f"CASE {x} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())} END"


def steps() -> list[dict[str, str]]:
    """Columns to set, in turn, from `term` to `stem`. e is the ending that a step has found."""
    from_r1 = "length(w) - length(e) >= r1"
    short = f"(r1 >= length(w) AND {_has('w', _SHORT_END)})"
    return [
        {"w": "CASE WHEN left(term, 1) = 'y' THEN 'Y' || substr(term, 2) ELSE term END"},
        {"w": f"CASE WHEN {_has('w', _V + 'y')} THEN {{every}} ELSE w END"},
        {"r1": f"CASE WHEN {_has('w', f'^(?:{"|".join(WHOLE_R1)})')} THEN length({_found('w', f'^(?:{"|".join(WHOLE_R1)})')}) WHEN {_has('w', _REGION)} THEN length({_found('w', _REGION)}) ELSE length(w) END"},
        {"r2": f"CASE WHEN {_has('substr(w, r1 + 1)', _REGION)} THEN r1 + length({_found('substr(w, r1 + 1)', _REGION)}) ELSE length(w) END"},
        {"e": _ending(["sses", "ied", "ies", "us", "ss", "s"])},
        {"w": f"CASE WHEN e = 'sses' THEN {_cut('2')} WHEN e IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {_cut('2')} ELSE {_cut('1')} END WHEN e = 's' AND {_has(_cut('2'), _V)} THEN {_cut('1')} ELSE w END"},
        {"stop": f"w IN ({_listed(AFTER_PLURAL)})"},
        {"e": f"CASE WHEN stop THEN '' ELSE {_ending(['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])} END"},
        {"cut": f"e IN ('ed', 'edly', 'ing', 'ingly') AND {_has(_cut('length(e)'), _V)}"},
        {"w": f"CASE WHEN e IN ('eed', 'eedly') AND {from_r1} THEN {_cut('length(e)')} || 'ee' WHEN cut THEN {_cut('length(e)')} ELSE w END"},
        {"w": f"CASE WHEN NOT cut THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' WHEN right(w, 2) IN ({_listed(DOUBLE)}) THEN {_cut('1')} WHEN {short} THEN w || 'e' ELSE w END"},
        {"w": f"CASE WHEN NOT stop AND length(w) > 2 AND {_has('w', f'{_C}[yY]$')} THEN {_cut('1')} || 'i' ELSE w END"},
        {"e": f"CASE WHEN stop THEN '' ELSE {_ending(STEP2)} END"},
        {"w": f"CASE WHEN e = '' OR NOT {from_r1} OR (e = 'ogi' AND {_found('w', 'logi$')} = '') OR (e = 'li' AND {_found('w', VALID_LI + 'li$')} = '') THEN w ELSE {_cut('length(e)')} || {_case('e', STEP2)} END"},
        {"e": f"CASE WHEN stop THEN '' ELSE {_ending(STEP3)} END"},
        {"w": f"CASE WHEN e = '' OR NOT {from_r1} OR (e = 'ative' AND length(w) - 5 < r2) THEN w ELSE {_cut('length(e)')} || {_case('e', STEP3)} END"},
        {"e": f"CASE WHEN stop THEN '' ELSE {_ending(STEP4)} END"},
        {"w": f"CASE WHEN e = '' OR length(w) - length(e) < r2 OR (e = 'ion' AND {_found('w', '[st]ion$')} = '') THEN w ELSE {_cut('length(e)')} END"},
        {"w": f"CASE WHEN stop THEN w WHEN right(w, 1) = 'e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND {_found(_cut('1'), _SHORT_END)} = '')) THEN {_cut('1')} WHEN right(w, 2) = 'll' AND length(w) - 1 >= r2 THEN {_cut('1')} ELSE w END"},
        {"stem": f"CASE WHEN length(term) <= 2 OR term IN ({_listed(UNCHANGED)}) THEN term WHEN term IN ({_listed(IRREGULAR)}) THEN {_case('term', IRREGULAR)} ELSE lower(w) END"},
    ]


def with_stem(df: DataFrame, term: str = "term", stem: str = "stem") -> DataFrame:
    """df with the stem of a column of lower-case words; null stays null. Words with a letter beyond a to z lose only the endings that fit."""
    out = df.withColumn("__term", F.col(term))
    own = {c: f"__{c}" for c in ("term", "w", "r1", "r2", "e", "stop", "cut", "stem")}
    for step in steps():
        for name, rule in step.items():
            rule = rule.replace("{every}", f"regexp_replace(w, '({_V})y', '$1Y')")
            rule = re.sub(r"'[^']*'|\b(term|w|r1|r2|e|stop|cut|stem)\b", lambda m: own[m[1]] if m[1] else m[0], rule)
            # steps name what comes before several times: a filter on the stem that moved below them would grow with each
            out = out.withColumn(own[name], F.when(F.spark_partition_id() >= 0, F.expr(rule)))
    return out.withColumn(stem, F.col("__stem")).drop(*own.values())


class _Ends:
    """Finds the longest of these endings that a word has, or the empty string."""

    def __init__(self, endings):
        self.any, self.longest = tuple(endings), sorted(endings, key=len, reverse=True)

    def of(self, w: str) -> str:
        return next(e for e in self.longest if w.endswith(e)) if w.endswith(self.any) else ""


_PLURAL, _PAST = _Ends(["sses", "ied", "ies", "us", "ss", "s"]), _Ends(["eedly", "ingly", "edly", "eed", "ing", "ed"])
_STEP2, _STEP3, _STEP4 = _Ends(STEP2), _Ends(STEP3), _Ends(STEP4)
_FIRST, _FROM, _CONSONANT_Y, _LI = re.compile(f"(?:{'|'.join(WHOLE_R1)})"), re.compile(_REGION), re.compile(f"({_V})y"), re.compile(f"{VALID_LI}li$")
_VOWEL, _SHORT, _LAST_Y = re.compile(_V), re.compile(_SHORT_END), re.compile(f"{_C}[yY]$")
#: Last letters of what a step can change.
_CHANGED = frozenset(e[-1] for e in [*_PLURAL.any, *_PAST.any, *STEP2, *STEP3, *STEP4, "y", "e", "ll"])


@lru_cache(1 << 18)
def stem(term: str) -> str:
    """The stem of one word of a to z and digits: what steps() say, for tasks that meet a word many times."""
    if len(term) <= 2 or term[-1] not in _CHANGED or term in UNCHANGED:
        return term
    if term in IRREGULAR:
        return IRREGULAR[term]
    region = lambda x: m.end() if (m := _FROM.match(x)) else len(x)
    w = "Y" + term[1:] if term[0] == "y" else term
    if "y" in w:
        w = _CONSONANT_Y.sub(r"\1Y", w)
    r1 = m.end() if (m := _FIRST.match(w)) else region(w)
    r2 = r1 + region(w[r1:])
    e = _PLURAL.of(w)
    if e == "sses" or (e in ("ied", "ies") and len(w) > 4):
        w = w[:-2]
    elif e in ("ied", "ies") or (e == "s" and _VOWEL.search(w[:-2])):
        w = w[:-1]
    if w in AFTER_PLURAL:
        return w.lower()
    e = _PAST.of(w)
    if e in ("eed", "eedly") and len(w) - len(e) >= r1:
        w = w[: -len(e)] + "ee"
    elif e in ("ed", "edly", "ing", "ingly") and _VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w[-2:] in ("at", "bl", "iz"):
            w += "e"
        elif w[-2:] in DOUBLE:
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and _LAST_Y.search(w):
        w = w[:-1] + "i"
    e = _STEP2.of(w)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w.endswith("logi")) and (e != "li" or _LI.search(w)):
        w = w[: -len(e)] + STEP2[e]
    e = _STEP3.of(w)
    if e and len(w) - len(e) >= r1 and (e != "ative" or len(w) - 5 >= r2):
        w = w[: -len(e)] + STEP3[e]
    e = _STEP4.of(w)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w.endswith(("sion", "tion"))):
        w = w[: -len(e)]
    if (w[-1:] == "e" and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])))) or (w[-2:] == "ll" and len(w) - 1 >= r2):
        w = w[:-1]
    return w.lower()


def sql_stems(words: str) -> str:
    """DuckDB: common table expressions from `words` (a table with a column term) to stems(term, stem)."""
    out, last = [], words
    for i, step in enumerate(steps()):
        for name, rule in step.items():
            rule = rule.replace("{every}", f"regexp_replace(w, '({_V})y', '\\1Y', 'g')")
            out.append(f"stem{i} AS (SELECT {'* EXCLUDE (' + name + '), ' if name in _set_before(i) else '*, '}{rule} AS {name} FROM {last})")
            last = f"stem{i}"
    return ",\n".join(out) + f",\nstems AS MATERIALIZED (SELECT term, stem FROM {last})"


def _set_before(i: int) -> set[str]:
    return {n for s in steps()[:i] for n in s}
