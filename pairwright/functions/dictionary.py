"""Abbreviation dictionaries as plan-time values, compiled to a token map."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

# Abbreviations by category, in the order in which later categories win.
COMPANY = {
    "pvt": "private", "pvt.": "private", "pvtltd": "private limited", "ltd": "limited", "ltd.": "limited",
    "llp": "limited liability partnership", "llp.": "limited liability partnership",
    "llc": "limited liability company", "llc.": "limited liability company",
    "co": "company", "co.": "company", "corp": "corporation", "corp.": "corporation",
    "inc": "incorporated", "inc.": "incorporated", "intl": "international", "intl.": "international",
    "plc": "public limited company", "plc.": "public limited company", "gmbh": "gmbh",
    "sa": "sociedad anonima", "ag": "aktiengesellschaft", "mfg": "manufacturing", "mfg.": "manufacturing",
    "tech": "technology", "tech.": "technology", "technologies": "technology", "serv": "services", "serv.": "services",
    "soln": "solutions", "solns": "solutions", "mgmt": "management", "mgmt.": "management",
    "assoc": "associates", "assoc.": "associates", "grp": "group", "grp.": "group",
    "ent": "enterprises", "ind": "industries", "inds": "industries", "sys": "systems", "comm": "communications",
}
ADDRESS = {
    "rd": "road", "rd.": "road", "st": "street", "st.": "street", "ave": "avenue", "ave.": "avenue",
    "av": "avenue", "av.": "avenue", "blvd": "boulevard", "blvd.": "boulevard", "ln": "lane", "ln.": "lane",
    "dr": "drive", "dr.": "drive", "ct": "court", "ct.": "court", "pl": "place", "pl.": "place",
    "sq": "square", "sq.": "square", "cres": "crescent", "pkwy": "parkway", "hwy": "highway", "hwy.": "highway",
    "apt": "apartment", "apt.": "apartment", "ste": "suite", "ste.": "suite", "fl": "floor", "fl.": "floor",
    "bldg": "building", "bldg.": "building", "no": "number", "no.": "number", "nr": "near", "nr.": "near",
    "opp": "opposite", "opp.": "opposite", "adj": "adjacent", "ext": "extension", "ext.": "extension",
    "sect": "sector", "sec": "sector", "blk": "block", "hno": "house number", "h.no": "house number",
    "po box": "post office box", "p.o. box": "post office box", "p.o box": "post office box",
    "po": "post office", "p.o.": "post office", "dist": "district",
    "nagar": "nagar", "colony": "colony", "layout": "layout", "phase": "phase",
}
DIRECTION = {
    "n": "north", "n.": "north", "s": "south", "s.": "south", "e": "east", "e.": "east", "w": "west", "w.": "west",
    "ne": "northeast", "ne.": "northeast", "nw": "northwest", "nw.": "northwest",
    "se": "southeast", "se.": "southeast", "sw": "southwest", "sw.": "southwest",
}
NAME = {
    "dr": "doctor", "dr.": "doctor", "mr": "mister", "mr.": "mister", "mrs": "mistress", "mrs.": "mistress",
    "ms": "miss", "ms.": "miss", "prof": "professor", "prof.": "professor",
    "sr": "senior", "sr.": "senior", "jr": "junior", "jr.": "junior", "shri": "shri", "smt": "smt",
}
STATE = {
    "tn": "tamil nadu", "t.n.": "tamil nadu", "ka": "karnataka", "mh": "maharashtra", "dl": "delhi", "kl": "kerala",
    "ap": "andhra pradesh", "ts": "telangana", "tg": "telangana", "wb": "west bengal", "up": "uttar pradesh",
    "mp": "madhya pradesh", "gj": "gujarat", "rj": "rajasthan", "hr": "haryana", "pb": "punjab", "or": "odisha",
    "br": "bihar", "jh": "jharkhand", "ct": "chhattisgarh", "ga": "georgia", "as": "assam",
    "ca": "california", "ny": "new york", "tx": "texas", "fl": "florida", "il": "illinois", "pa": "pennsylvania",
    "oh": "ohio", "nc": "north carolina", "mi": "michigan", "nj": "new jersey", "va": "virginia",
    "wa": "washington", "az": "arizona", "ma": "massachusetts",
}
CATEGORIES = {"company": COMPANY, "address": ADDRESS, "direction": DIRECTION, "name": NAME, "state": STATE}
#: What parts tokens, as the inside of a character class for Java and Python alike.
DELIMITERS = r"\s,;/\-()\[\]{}:"


def _clean(text: str) -> str:
    return text.strip().lower()


@dataclass(frozen=True)
class AbbreviationRules:
    """The built-in dictionaries with custom rules on top; changes return new rules."""

    custom: tuple[tuple[str, str], ...] = field(default=())

    def add(self, abbreviation: str, expansion: str) -> AbbreviationRules:
        return AbbreviationRules(tuple({**dict(self.custom), _clean(abbreviation): _clean(expansion)}.items()))

    def remove(self, abbreviation: str) -> AbbreviationRules:
        return AbbreviationRules(tuple((k, v) for k, v in self.custom if k != _clean(abbreviation)))

    def clear(self) -> AbbreviationRules:
        return AbbreviationRules()

    def merged(self, category: str | None = None) -> dict[str, str]:
        """One category's rules, or all; an unknown category has the custom rules only."""
        if category is None or category == "all":
            names = list(CATEGORIES)
        elif category == "address":
            names = ["address", "direction", "state"]
        else:
            names = [category] if category in CATEGORIES else []
        out: dict[str, str] = {}
        for name in names:
            out.update(CATEGORIES[name])
        out.update(dict(self.custom))
        return {k: v for k, v in out.items() if k}

    @lru_cache(maxsize=64)
    def compiled(self, category: str | None = None) -> tuple[list[tuple[str, str]], dict[str, str]]:
        """(phrases that hold a delimiter, longest first) and a map of single tokens, with their dotted forms.

        Rules apply from the longest on, so an expansion may be rewritten by a shorter rule: that is worked out here.
        """
        rules = self.merged(category)
        order = sorted(rules, key=len, reverse=True)
        rank = {k: i for i, k in enumerate(order)}
        patterns = [re.compile(self._pattern(k), re.I) for k in order]

        def settled(key: str, expansion: str) -> str:
            """The expansion after all the rules that come later than key's."""
            done = rank[key]
            while True:
                done = next((i for i in range(done + 1, len(order)) if patterns[i].search(f" {expansion} ")), None)
                if done is None:
                    return expansion
                expansion = patterns[done].sub(lambda _: rules[order[done]], f" {expansion} ")[1:-1]

        phrases, tokens = [], {}
        for key in order:
            result = settled(key, rules[key])
            if re.search(f"[{DELIMITERS}]", key):
                phrases.append((key, result))
            else:
                tokens.setdefault(key, result)
                if not key.endswith("."):
                    tokens.setdefault(key + ".", rules[key + "."] if key + "." in rules else result)
        return phrases, tokens

    @staticmethod
    def _pattern(key: str) -> str:
        dot = "" if key.endswith(".") else r"\.?"
        return rf"(?<=[{DELIMITERS}]){re.escape(key)}{dot}(?=[{DELIMITERS}])"
