"""Lexicons of entities: terms, their patterns, and words to stop.

A lexicon maps a ticker to cashtags, exact_tickers, company_names, whether it
requires_context, and context_keywords (the layout of the JSON files that users
have); aliases are kept for stop words only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

SOURCES = (("cashtags", "cashtag"), ("exact_tickers", "ticker"), ("company_names", "company_name"))
_ALIASES = ("company_names", "safe_aliases", "risky_aliases", "exact_tickers")


@dataclass(frozen=True)
class Term:
    ticker: str
    term: str
    kind: str
    pattern: str


@dataclass(frozen=True)
class Lexicon:
    """Compiled terms in order; ``context`` has the pattern of each ticker that is only matched in context."""

    terms: tuple[Term, ...]
    needs_context: frozenset[str] = frozenset()
    context: dict[str, str] = field(default_factory=dict)

    @property
    def tickers(self) -> list[str]:
        return list(dict.fromkeys(t.ticker for t in self.terms))


_META = re.compile(r"([\\.^$|?*+()\[\]{}\-&#~\s])")


def _literal(term: str) -> str:
    return _META.sub(r"\\\1", term)


#: What doesn't stand before and after a term: for tickers ASCII letters, digits (and $ before); for others word characters.
_AROUND = {True: ("[A-Za-z0-9$]", "[A-Za-z0-9]"), False: (r"\w", r"\w")}


def term_pattern(term: str, kind: str) -> str:
    """Java pattern of a term; what stands before is looked at last, so that at most places the first letter decides."""
    (before, after), body = _AROUND[kind == "ticker"], _literal(term)
    return f"(?iuU){body}(?<!{before}{body})(?!{after})"


def any_pattern(terms: Iterable[Term]) -> str | None:
    """One Java pattern that finds what any of the ``terms``' patterns finds."""
    terms = list(terms)
    parts = []
    for ticker in (True, False):
        own = dict.fromkeys(_literal(t.term) for t in terms if (t.kind == "ticker") == ticker)
        if own:
            before, after = _AROUND[ticker]
            parts.append(f"(?<!{before})(?:{'|'.join(own)})(?!{after})")
    return f"(?iuU)(?:{'|'.join(parts)})" if parts else None


def context_pattern(keywords: Iterable[str]) -> str | None:
    clean = [" ".join(k.split()) for k in keywords]
    clean = [k for k in clean if k]
    return rf"(?iuU)(?<!\w)(?:{'|'.join(map(_literal, clean))})(?!\w)" if clean else None


def compile_lexicon(entries: dict[str, dict], universe: Iterable[str] | None = None, sources: Iterable[str] = ("cashtags", "exact_tickers", "company_names")) -> Lexicon:
    """Terms of the tickers in ``universe`` (all, if it is empty) from the active ``sources``; terms that differ in case only are one, the first."""
    wanted, active = set(universe or ()), set(sources)
    terms: list[Term] = []
    seen: set[tuple[str, str, str]] = set()
    for ticker, entry in entries.items():
        if wanted and ticker not in wanted:
            continue
        for source, kind in SOURCES:
            for term in entry.get(source, ()) if source in active else ():
                key = (ticker, term.lower(), kind)
                if term and key not in seen:
                    seen.add(key)
                    terms.append(Term(ticker, term, kind, term_pattern(term, kind)))
    gated = {t: e for t, e in entries.items() if e.get("requires_context") and (not wanted or t in wanted)}
    patterns = {t: p for t, e in gated.items() if (p := context_pattern(e.get("context_keywords", ())))}
    return Lexicon(tuple(terms), frozenset(gated), patterns)


def load_lexicon(path: str, universe_path: str | None = None) -> Lexicon:
    """From a lexicon file and, if given, a file with the list of tickers under "tickers" or as its only list."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    universe = None
    if universe_path:
        with open(universe_path, encoding="utf-8") as f:
            u = json.load(f)
        lists = [u] if isinstance(u, list) else [u["tickers"]] if "tickers" in u else [v for v in u.values() if isinstance(v, list)]
        universe = [x["ticker"] if isinstance(x, dict) else x for x in (lists[0] if lists else [])]
    return compile_lexicon(entries, universe)


def alias_stop_words(entries: dict[str, dict], tickers: Iterable[str]) -> set[str]:
    """Lower-case words of the names and aliases of ``tickers``, for the topic models' stop list."""
    return {w for t in tickers for f in _ALIASES for term in entries.get(t, {}).get(f, ()) for w in re.findall(r"[a-z]+", term.lower())}
