"""Text analysis as column expressions: splitting by language, stop words, stemming hooks, diacritics, edit distance."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .stemming import STEMMED, STEMMERS, stem_array

ALIASES = {"en": "english", "de": "german", "fr": "french", "fi": "finnish", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish"}


def _both(letters: str) -> str:
    return letters + "".join(c.upper() for c in letters if len(c.upper()) == 1 and c.upper() != c)


def _span(first: int, last: int) -> str:
    return f"{chr(first)}-{chr(last)}"


#: what may stand in a token besides a-z and 0-9, by language
_ROMANCE = "àèéìòóù_'-"
_CYRILLIC = _span(0x430, 0x44F) + _span(0x410, 0x42F)
_DEVANAGARI = _span(0x905, 0x939)
LETTERS: dict[str, str] = {
    "english": _ROMANCE,
    "dutch": _ROMANCE,
    "italian": _ROMANCE,
    "french": "çàâäèéêëîïôöùûüœ-",
    "german": _both("äöü") + "ß",
    "spanish": _span(0xE1, 0xFA) + _span(0xC1, 0xDA) + _both("ñü"),
    "portuguese": _span(0xE0, 0xFA) + _span(0xC0, 0xDA),
    "danish": _both("åæø"),
    "norwegian": _both("åäæöøü") + "_",
    "swedish": _both("åäö") + "üÜ_-",
    "finnish": _both("äö"),
    "hungarian": _both("áéíóöúüőű"),
    "romanian": _both("âîășț"),
    "serbian": _both("ćčđšž"),
    "slovenian": _both("čšž"),
    "turkish": "çÇöÖüÜğĞıİşŞ",
    "lithuanian": _both("ąčėęįšūųž"),
    "irish": _both("áéíóú"),
    "czech": _both("áéíóúýčďěřšťůž") + "-",
    "russian": _CYRILLIC + "ёЁ",
    "ukrainian": _CYRILLIC + _both("єії"),
    "bulgarian": _CYRILLIC,
    "greek": _span(0x3AC, 0x3CE),
    "armenian": _span(0x561, 0x586),
    "arabic": _span(0x623, 0x64A),
    "indian": _DEVANAGARI,
    "nepali": _DEVANAGARI,
    "sanskrit": "āīūṛṝḷḹḻṃṁḥśṣṭḍṇṅñ",
    "tamil": _span(0xB85, 0xBB9),
    "indonesian": "",
}
LANGUAGES = sorted(LETTERS)


def language_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in LETTERS:
        raise ValueError(f"unsupported language {name!r}")
    return name


def splitter(language: str) -> str:
    """A regex for the stretches between tokens; texts are lower-cased first."""
    extra = LETTERS[language_name(language)]
    hyphen = "-" if extra.endswith("-") else ""
    return f"(?i)[^0-9a-z{extra.removesuffix('-')}{hyphen}]+"


@lru_cache(maxsize=1)
def _stop_words() -> dict[str, frozenset[str]]:
    raw = json.loads(Path(__file__).with_name("stopwords.json").read_text("utf-8"))
    return {k: frozenset(v.split("\n")) for k, v in raw.items()}


def stop_words(language: str) -> frozenset[str]:
    """The built-in list; Japanese and Chinese lists exist although no splitter does. Unknown languages have none."""
    return _stop_words().get(language, frozenset())


_FROM = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ" + "".join(chr(c) for c in range(0x100, 0x180))
_TO = (
    "AAAAAAACEEEEIIIIENOOOOOOUUUUYPsaaaaaaaceeeeiiiienoooooouuuuypy"
    "AaAaAaCcCcCcCcDdDdEeEeEeEeEeGgGgGgGgHhHhIiIiIiIiIiIiJjKkkLlLlLlLlLlNnNnNnnNnOoOoOoOoRrRrRrSsSsSsSsTtTtTtUuUuUuUuUuUuWwYyYZzZzZzs"
)
assert len(_FROM) == len(_TO)


def replace_diacritics(c: Column) -> Column:
    """Letters of U+00C0 to U+017F without their marks, one for one."""
    return F.translate(c, _FROM, _TO)


@lru_cache(maxsize=64)
def letter_moves(language: str) -> tuple[str, str]:
    """Those of the marks' replacements whose letters the language's splitter keeps; all give letters that it keeps."""
    own = re.compile(splitter(language).removeprefix("(?i)"))
    pairs = [(a, b) for a, b in zip(_FROM, _TO) if a == a.lower() and not own.fullmatch(a)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def replace_diacritics_py(s: str) -> str:
    return s.translate(str.maketrans(_FROM, _TO))


@dataclass(frozen=True)
class Tokenizer:
    """Lower-case, split, drop stop words, stem, strip diacritics, drop repeats (unless allowed).

    ``stemmer``: maps a column of token arrays to one of stemmed arrays. ``custom``: replaces everything else, maps a text
    column to token arrays; it excludes the other options.
    """

    language: str = "english"
    stemming: bool = False
    stemmer: Callable[[Column], Column] | None = None
    words: tuple[str, ...] | None = None
    use_default_stop_words: bool = False
    allow_duplicates: bool = False
    skip: frozenset[str] = frozenset()
    stem_skip: frozenset[str] = frozenset()
    custom: Callable[[Column], Column] | None = field(default=None)

    def __post_init__(self):
        object.__setattr__(self, "language", language_name(self.language))
        object.__setattr__(self, "skip", frozenset(self.skip))
        object.__setattr__(self, "stem_skip", frozenset(self.stem_skip))
        if self.custom is not None and replace(self, custom=None) != Tokenizer():
            raise ValueError("a custom tokenizer takes no other options")

    @property
    def stop_words(self) -> frozenset[str] | None:
        if self.words is not None:
            return frozenset(self.words) or None
        return (stop_words(self.language) or None) if self.use_default_stop_words else None

    @property
    def portable(self) -> bool:
        """Whether a snapshot can describe it."""
        return self.custom is None and self.stemmer is None

    def _normal(self, tokens: Column, prop: str | None) -> Column:
        stop = self.stop_words
        if stop:
            bad = F.array(*(F.lit(w) for w in sorted(stop)))
            tokens = F.filter(tokens, lambda x: ~F.array_contains(bad, x))
        if prop is None or prop not in self.stem_skip:
            if self.stemmer is not None:
                tokens = self.stemmer(tokens)
            elif self.stemming and self.language in STEMMED:
                tokens = stem_array(tokens, self.language)
        return F.filter(F.transform(tokens, replace_diacritics), lambda x: x != "")

    def column(self, text: Column, prop: str | None = None, language: str | None = None) -> Column:
        """The tokens of a text column; null for a null text."""
        if language is not None and language_name(language) != self.language:
            raise ValueError(f"this tokenizer is for {self.language}, not {language}")
        if self.custom is not None:
            tokens = self.custom(text)
        elif prop is not None and prop in self.skip:
            tokens = self._normal(F.array(text), prop)
        elif self.stop_words is None and not self.stemming and self.stemmer is None:
            # nothing looks at single tokens: marks come off the whole text, where only letters of the language can be part of a token
            found, put = letter_moves(self.language)
            tokens = F.array_remove(F.split(F.translate(F.lower(text), found, put) if found else F.lower(text), splitter(self.language)), "")
        else:
            raw = F.array_remove(F.split(F.lower(text), splitter(self.language)), "")
            tokens = self._normal(raw if self.allow_duplicates else F.array_distinct(raw), prop)
        if not self.allow_duplicates:
            tokens = F.array_distinct(tokens)
        return F.when(text.isNotNull(), tokens)

    def tokenize(self, spark, text: str, prop: str | None = None) -> list[str]:
        """Tokens of one string, as :meth:`column` gives them. Only user functions need a Spark job for it."""
        if not self.portable:
            return spark.range(1).select(self.column(F.lit(text), prop).alias("t")).first()[0]
        raw = [text] if prop is not None and prop in self.skip else [t for t in re.split(splitter(self.language).removeprefix("(?i)"), text.lower()) if t]
        stop = self.stop_words or ()
        tokens = [t for t in raw if t not in stop]
        if self.stemming and self.language in STEMMED and (prop is None or prop not in self.stem_skip):
            tokens = [STEMMERS[self.language](t) for t in tokens]
        tokens = [t for t in map(replace_diacritics_py, tokens) if t]
        return tokens if self.allow_duplicates else list(dict.fromkeys(tokens))


def within(term: Column, word: Column, tolerance: int) -> Column:
    """Fuzzy match: the word begins with the term, or is within ``tolerance`` edits of it."""
    near = (F.abs(F.length(term) - F.length(word)) <= tolerance) & (F.levenshtein(term, word, tolerance) >= 0)
    return F.startswith(word, term) | near


def bounded_levenshtein(term: Column, word: Column, tolerance: int) -> Column:
    """Edits between them up to ``tolerance``, 0 where the word begins with the term, null beyond."""
    d = F.levenshtein(term, word, tolerance)
    return F.when(F.startswith(word, term), F.lit(0)).when(d >= 0, d)


def sort_key(c: Column, language: str) -> Column:
    """A key whose byte order is the language's order of strings."""
    moves = {
        "norwegian": [("æ", "{a"), ("ø", "{b"), ("å", "{c")],
        "danish": [("æ", "{a"), ("ø", "{b"), ("å", "{c")],
        "swedish": [("å", "{a"), ("ä", "{b"), ("ö", "{c")],
        "german": [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")],
    }.get(language, [])
    out = F.lower(c)
    for a, b in moves:
        out = F.replace(out, F.lit(a), F.lit(b))
    return replace_diacritics(out)


def check_tolerance(tolerance: int) -> None:
    if tolerance < 0:
        raise QueryError("tolerance must not be negative")


def first_tokens(token_lists: Iterable[list[str]]) -> list[str]:
    return [t[0] for t in token_lists if t]
