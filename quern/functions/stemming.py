"""Snowball stemmers (English, German, Spanish, Swedish, Danish, Norwegian), written from their published descriptions, as an
Arrow function.

Each distinct token is stemmed once in a worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _V and w[i - 1] in _V:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(maxsize=200_000)
def stem_english(word: str) -> str:
    if len(word) < 3:
        return word
    w = word.lstrip("'") if word.startswith("'") else word
    if w in _WHOLE:
        return _WHOLE[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):  # 0
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):  # 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):  # 1b
        if w.endswith(s):
            if s in ("eedly", "eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _V for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif len(w) <= r1 and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:  # 1c
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "li":
                    w = w[:-2] if len(w) > 2 and w[-3] in _LI else w
                elif s == "ogi":
                    w = w[:-1] if len(w) > 3 and w[-4] == "l" else w
                else:
                    w = w[: -len(s)] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or (at and w[at - 1] in "st")):
                w = w[:at]
            break
    if w.endswith("e"):  # 5
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _after(w: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _longest(w: str, endings: tuple[str, ...], start: int) -> str:
    """The longest of the endings that lies wholly in the region from ``start``."""
    return max((e for e in endings if w.endswith(e) and len(w) - len(e) >= start), key=len, default="")


_DE = "aeiouyäöü"


@lru_cache(maxsize=200_000)
def stem_german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_DE}])u(?=[{_DE}])", "U", w)
    w = re.sub(f"(?<=[{_DE}])y(?=[{_DE}])", "Y", w)
    r1 = _after(w, _DE)
    r2 = _after(w, _DE, r1) if r1 < len(w) else len(w)
    r1 = max(r1, 3)
    e = max((x for x in ("em", "ern", "er", "e", "en", "es", "s") if w.endswith(x)), key=len, default="")
    if e and len(w) - len(e) >= r1:
        if e in ("em", "ern", "er"):
            w = w[: -len(e)]
        elif e in ("e", "en", "es"):
            w = w[: -len(e)]
            if w.endswith("niss"):
                w = w[:-1]
        elif len(w) > 1 and w[-2] in "bdfghklmnrt":
            w = w[:-1]
    e = max((x for x in ("en", "er", "est", "st") if w.endswith(x)), key=len, default="")
    if e and len(w) - len(e) >= r1:
        if e != "st":
            w = w[: -len(e)]
        elif len(w) >= 6 and w[-3] in "bdfghklmnt":
            w = w[:-2]
    e = max((x for x in ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit") if w.endswith(x)), key=len, default="")
    if e and len(w) - len(e) >= r2:
        rest = w[: -len(e)]
        if e in ("end", "ung"):
            w = rest
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = rest if not rest.endswith("e") else w
        elif e in ("lich", "heit"):
            w = rest
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = rest
            f = _longest(w, ("lich", "ig"), r2)
            w = w[: len(w) - len(f)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


_SV = "aeiouyäåö"
_SV_1 = tuple("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split())


@lru_cache(maxsize=200_000)
def stem_swedish(w: str) -> str:
    r1 = max(_after(w, _SV), 3)
    e = _longest(w, (*_SV_1, "s"), r1)
    if e == "s":
        if len(w) > 1 and w[-2] in "bcdfghjklmnoprtvy":
            w = w[:-1]
    elif e:
        w = w[: -len(e)]
    if _longest(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    e = _longest(w, ("lig", "ig", "els", "löst", "fullt"), r1)
    if e in ("lig", "ig", "els"):
        w = w[: -len(e)]
    elif e:
        w = w[:-1]
    return w


_DA = "aeiouyæåø"
_DA_1 = tuple("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split())


@lru_cache(maxsize=200_000)
def stem_danish(w: str) -> str:
    r1 = max(_after(w, _DA), 3)
    e = _longest(w, (*_DA_1, "s"), r1)
    if e == "s":
        if len(w) > 1 and w[-2] in "abcdfghjklmnoprtvyzå":
            w = w[:-1]
    elif e:
        w = w[: -len(e)]
    pairs = ("gd", "dt", "gt", "kt")
    if _longest(w, pairs, r1):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    e = _longest(w, ("ig", "lig", "elig", "els", "løst"), r1)
    if e == "løst":
        w = w[:-1]
    elif e:
        w = w[: -len(e)]
        if _longest(w, pairs, r1):
            w = w[:-1]
    if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in _DA:
        w = w[:-1]
    return w


_NO_1 = tuple("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split())


@lru_cache(maxsize=200_000)
def stem_norwegian(w: str) -> str:
    r1 = max(_after(w, _DA), 3)
    e = _longest(w, (*_NO_1, "s", "erte", "ert"), r1)
    if e == "s":
        if len(w) > 1 and (w[-2] in "bcdfghjlmnoprtvyz" or (w[-2] == "k" and len(w) > 2 and w[-3] not in _DA)):
            w = w[:-1]
    elif e in ("erte", "ert"):
        w = w[: -len(e)] + "er"
    elif e:
        w = w[: -len(e)]
    if _longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    e = _longest(w, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1)
    return w[: len(w) - len(e)]


_ES = "aeiouáéíóúü"
_PLAIN = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_ES_Y = tuple("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
_ES_VERB = tuple(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
)


def _rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in _ES:
        return next((i + 1 for i in range(2, len(w)) if w[i] in _ES), len(w))
    if w[0] in _ES:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in _ES), len(w))
    return 3


@lru_cache(maxsize=200_000)
def stem_spanish(word: str) -> str:
    w = word
    rv, r1 = _rv(w), _after(w, _ES)
    r2 = _after(w, _ES, r1) if r1 < len(w) else len(w)
    e = max((x for x in _ES_PRONOUNS if w.endswith(x)), key=len, default="")
    if e and len(w) - len(e) >= rv:
        rest = w[: -len(e)]
        v = max((x for x in ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir") if rest.endswith(x) and len(rest) - len(x) >= rv), key=len, default="")
        if v:
            w = rest[: -len(v)] + v.translate(_PLAIN)
        elif rest.endswith("uyendo") and len(rest) - 5 >= rv:
            w = rest
    before = w

    def drop(e: str, to: str = "") -> bool:
        nonlocal w
        if w.endswith(e) and len(w) - len(e) >= r2:
            w = w[: -len(e)] + to
            return True
        return False

    ends = tuple("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split())
    e = max((x for x in ends if w.endswith(x)), key=len, default="")
    if e in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
        if drop(e):
            drop("ic")
    elif e in ("logía", "logías"):
        drop(e, "log")
    elif e in ("ución", "uciones"):
        drop(e, "u")
    elif e in ("encia", "encias"):
        drop(e, "ente")
    elif e == "amente":
        if len(w) - 6 >= r1:
            w = w[:-6]
            if drop("iv"):
                drop("at")
            else:
                any(drop(x) for x in ("os", "ic", "ad"))
    elif e == "mente":
        if drop(e):
            any(drop(x) for x in ("ante", "able", "ible"))
    elif e in ("idad", "idades"):
        if drop(e):
            any(drop(x) for x in ("abil", "ic", "iv"))
    elif e in ("iva", "ivo", "ivas", "ivos"):
        if drop(e):
            drop("at")
    elif e:
        drop(e)
    if w == before:
        e = max((x for x in _ES_Y if w.endswith(x) and len(w) - len(x) >= rv), key=len, default="")
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        else:
            e = max((x for x in (*_ES_VERB, "en", "es", "éis", "emos") if w.endswith(x) and len(w) - len(x) >= rv), key=len, default="")
            if e:
                w = w[: -len(e)]
                if e in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    e = max((x for x in ("os", "a", "o", "á", "í", "ó", "e", "é") if w.endswith(x) and len(w) - len(x) >= rv), key=len, default="")
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS = {"english": stem_english, "german": stem_german, "swedish": stem_swedish, "danish": stem_danish, "norwegian": stem_norwegian, "spanish": stem_spanish}
STEMMED = frozenset(STEMMERS)


def stem_array(tokens: Column, language: str) -> Column:
    """Stems of a column of token arrays; as they are for a language without a stemmer."""
    if language not in STEMMERS:
        return tokens
    stem = STEMMERS[language]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda t: None if t is None else [stem(x) for x in t])

    return run(tokens)
