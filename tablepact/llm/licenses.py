"""License scans: ordered signature rules, on column functions alone.

A rule is a pattern over the words of a text, with a label, keys, a priority and a weight. One literal pattern
finds the keys that a text holds; a rule is tried only on texts that hold one of its keys and, for a name,
a word that licences are named with. Where detections overlap, one whose interval lies within that of a
stronger rule is suppressed. Everything is one map over the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.shared import marker
from tablepact.llm.spans import let, placed

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    keys: str
    pattern: str
    priority: int
    weight: float
    base: bool = False
    context: str = ""


#: Phrases whose every place is reported, with label, keys and context: fixed values.
BASE_PHRASES = {
    "under the mit license": ("mit", "mit", "under"),
    "apache license version 2": ("apache-2", "apache", "licen"),
    "cc by nc": ("cc-by-nc", "cc", ""),
}

#: label, keys, the words of the name as a pattern, the words of its SPDX identifier. One key, as the beginning of
#: a word, is in whatever the pattern matches.
FAMILIES = [
    ("mit", "mit expat", r"(?:mit|expat|mit x11)", "mit"),
    ("mit-0", "mit", r"mit no attribution", "mit 0"),
    ("isc", "isc", r"isc", "isc"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd 0 clause|bsd zero clause)", "0bsd"),
    ("bsd-2", "bsd", r"(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause)", "bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause)", "bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause)", "bsd 4 clause"),
    ("apache-1", "apache", r"apache(?: software)? (?:license )?(?:version |v)?1(?: [01])?", "apache 1 1"),
    ("apache-2", "apache", r"apache(?: software)? (?:license )?(?:version |v)?2(?: 0)?", "apache 2 0"),
    ("gpl-1", "gpl general", r"(?:gnu )?(?:general public license|gpl) (?:version |v)?1(?: 0)?", "gpl 1 0"),
    ("gpl-2", "gpl general", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", "gpl general", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2", "lgpl library", r"(?:gnu )?(?:library general public license|lgpl) ?(?:version |v)?2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "lgpl lesser", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?2 1", "lgpl 2 1"),
    ("lgpl-3", "lgpl lesser", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3", "agpl affero", r"(?:gnu )?(?:affero general public license|agpl) ?(?:version |v)?3(?: 0)?", "agpl 3 0"),
    ("gfdl", "gnu", r"gnu free documentation", "gfdl 1 3"),
    ("mpl-1", "mpl mozilla", r"(?:mozilla public license|mpl) (?:version |v)?1(?: [01])?", "mpl 1 1"),
    ("mpl-2", "mpl mozilla", r"(?:mozilla public license|mpl) (?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("epl-1", "epl eclipse", r"(?:eclipse public license|epl) (?:version |v)?1(?: 0)?", "epl 1 0"),
    ("epl-2", "epl eclipse", r"(?:eclipse public license|epl) (?:version |v)?2(?: 0)?", "epl 2 0"),
    ("eupl", "eupl european", r"(?:european union public license|eupl)(?: (?:version |v)?1 [012])?", "eupl 1 2"),
    ("cddl", "cddl development", r"(?:common development and distribution license|cddl)(?: (?:version |v)?1 [01])?", "cddl 1 0"),
    ("cpl", "cpl common", r"(?:common public license|cpl)(?: (?:version |v)?1 0)?", "cpl 1 0"),
    ("artistic-1", "artistic", r"artistic license(?: 1 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", r"artistic license (?:version |v)?2(?: 0)?", "artistic 2 0"),
    ("boost", "boost bsl", r"(?:boost software license|bsl 1 0)(?: (?:version )?1 0)?", "bsl 1 0"),
    ("busl", "busl business", r"(?:business source license|busl)(?: 1 1)?", "busl 1 1"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng)", "zlib"),
    ("libpng", "libpng", r"libpng", "libpng"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "wtfpl fuck", r"(?:wtfpl|do what the fuck you want to public license)", "wtfpl"),
    ("python", "python psf", r"(?:python software foundation|psf)", "psf 2 0"),
    ("ruby", "ruby", r"ruby", "ruby"),
    ("php", "php", r"php(?: license)?(?: (?:version |v)?3 0?1)?", "php 3 01"),
    ("perl", "perl", r"same terms as perl(?: itself)?", "artistic 1 0 perl"),
    ("openssl", "openssl", r"openssl", "openssl"),
    ("ofl", "font", r"(?:sil )?open font(?: license)?(?: (?:version )?1 1)?", "ofl 1 1"),
    ("odbl", "odbl database", r"(?:open database license|odbl)(?: 1 0)?", "odbl 1 0"),
    ("odc-by", "commons", r"open data commons attribution", "odc by 1 0"),
    ("pddl", "pddl dedication", r"(?:public domain dedication and license|pddl)", "pddl 1 0"),
    ("postgresql", "postgresql", r"postgresql", "postgresql"),
    ("vim", "vim", r"vim", "vim"),
    ("w3c", "w3c", r"w3c(?: software)?", "w3c"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("ms-pl", "microsoft ms", r"(?:microsoft public license|ms pl)", "ms pl"),
    ("ms-rl", "microsoft ms", r"(?:microsoft reciprocal license|ms rl)", "ms rl"),
    ("afl", "afl academic", r"(?:academic free license|afl)(?: 3 0)?", "afl 3 0"),
    ("osl", "osl software", r"(?:open software license|osl)(?: 3 0)?", "osl 3 0"),
    ("ecl", "ecl educational", r"(?:educational community license|ecl)(?: 2 0)?", "ecl 2 0"),
    ("upl", "universal", r"universal permissive", "upl 1 0"),
    ("sspl", "sspl server", r"(?:server side public license|sspl)(?: (?:version )?1)?", "sspl 1 0"),
    ("elastic-2", "elastic", r"elastic license(?: 2 0)?", "elastic 2 0"),
    ("mulan-2", "mulan", r"mulan psl(?: v2)?", "mulanpsl 2 0"),
    ("cecill", "cecill", r"cecill(?: b| c)?", "cecill 2 1"),
    ("hpnd", "historical", r"historical permission notice", "hpnd"),
    ("cc0", "cc0 cc creative", r"(?:cc0|cc zero|creative commons zero)(?: (?:version )?1 0)?", "cc0 1 0"),
    ("cc-by", "cc creative", r"(?:cc by|creative commons attribution)(?: [1-4] [0-9])?", "cc by 4 0"),
    ("cc-by-sa", "cc creative", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [0-9])?", "cc by sa 4 0"),
    ("cc-by-nd", "cc creative", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [0-9])?", "cc by nd 4 0"),
    ("cc-by-nc", "cc creative", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [0-9])?", "cc by nc 4 0"),
    ("cc-by-nc-sa", "cc creative", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [0-9])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc creative", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [0-9])?", "cc by nc nd 4 0"),
    ("llama", "llama", r"llama [23](?: [0-9])? community", "llama3"),
    ("openrail", "openrail rail responsible", r"(?:open ?rail(?: m)?|responsible ai)", "openrail"),
]

#: Ways to name a licence: pattern around the name, context, priority, weight.
PHRASINGS = [
    (r"(?:is |are )?(?:licen[sc]ed|released|distributed|available|provided|published) (?:to you )?under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?", "under", 80, 0.95),
    (r"under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?", "under", 70, 0.9),
    (r"{name} licen[sc]e(?: (?:agreement|terms))?", "licen", 60, 0.8),
    (r"licen[sc]es? {name}", "licen", 55, 0.75),
    (r"spdx licen[sc]e identifier {spdx}(?: only| or later)?", "", 90, 1.0),
]

#: Signatures of texts rather than names: label, keys, pattern, priority, weight.
PASSAGES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 85, 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 85, 0.9),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose", 85, 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 85, 0.9),
    ("bsd-3", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 86, 0.9),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 87, 0.95),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the licen[sc]e", 84, 0.85),
    ("mpl-1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]", 86, 0.95),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 86, 0.95),
    ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0", 86, 0.95),
    ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0", 86, 0.95),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 87, 0.95),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 85, 0.9),
    ("libpng", "png", r"the png reference library is supplied as is", 85, 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 88, 0.95),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 85, 0.9),
    ("cc0", "waive", r"to the extent possible under law (?:[^ ]+ ){1,8}waived all copyright and related or neighboring rights", 85, 0.9),
    ("beerware", "beer", r"you can buy me a beer in return", 85, 0.9),
    ("json", "evil", r"the software shall be used for good not evil", 87, 0.95),
    ("curl", "curl", r"curl licen[sc]e", 60, 0.8),
    ("ofl", "font", r"the font software may be modified altered or added to", 85, 0.9),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty", 40, 0.6),
    ("no-warranty", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose", 40, 0.6),
    ("gpl", "gnu", r"gnu general public licen[sc]e", 50, 0.7),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it", 64, 0.85),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it", 64, 0.85),
    ("lgpl", "lesser", r"gnu lesser general public licen[sc]e", 52, 0.7),
    ("agpl", "affero", r"gnu affero general public licen[sc]e", 52, 0.7),
    ("gpl-2-or-later", "either", r"either version 2 of the licen[sc]e or at your option any later version", 65, 0.9),
    ("gpl-3-or-later", "either", r"either version 3 of the licen[sc]e or at your option any later version", 65, 0.9),
    ("public-domain", "domain", r"(?:released|placed|dedicated|in)(?: in| into| to)? the public domain", 45, 0.7),
    ("proprietary", "reserved", r"all rights reserved", 10, 0.3),
    ("confidential", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 48, 0.7),
    ("non-commercial", "noncommercial commercial personal", r"for (?:non ?commercial|personal) use only", 46, 0.6),
    ("copyright", "copyright", r"copyright (?:c |holder )?[0-9]{4}", 5, 0.2),
]


def rules() -> list[Rule]:
    out = [Rule(label, keys, phrase, 100, 1.0, True, context) for phrase, (label, keys, context) in BASE_PHRASES.items()]
    for label, keys, name, spdx in FAMILIES:
        for pattern, context, priority, weight in PHRASINGS:
            gate = "spdx" if "{spdx}" in pattern else keys
            out.append(Rule(label, gate, pattern.format(name=name, spdx=spdx), priority, weight, context=context))
        if name.startswith(r"(?:cc"):
            out.append(Rule(label, keys, name, 58, 0.7))
    out += [Rule(*passage) for passage in PASSAGES]
    return out


def key_pattern(keys: list[str]) -> str:
    """A pattern for the beginnings of words that are keys, the longest where several fit; sorted by first letter, as few fit it."""
    keys = sorted(set(keys), key=lambda k: (k[0], -len(k), k))
    starts = [f"{first}(?:{'|'.join(re.escape(k[1:]) for k in own)})" for first, own in groupby(keys, lambda k: k[0])]
    return f" ({'|'.join(starts)})" if starts else "(?!)()"


def all_keys(ruleset: list[Rule]) -> list[str]:
    return [k for rule in ruleset for k in f"{rule.keys} {rule.context}".split()]


def first_keys(ruleset: list[Rule]) -> list[str]:
    """Keys of which a text that any rule matches holds one."""
    return [k for rule in ruleset for k in (rule.context or rule.keys).split()]


def gate(rule: Rule, ruleset: list[Rule]) -> tuple[tuple[str, ...], ...]:
    """Groups of keys; a text must hold one of each: the rule's own, and longer ones that stand in their place."""
    every = set(all_keys(ruleset))
    groups = [own.split() for own in (rule.keys, rule.context) if own]
    return tuple(tuple(sorted(k for k in every if any(k.startswith(o) for o in own))) for own in groups)


def normal_words(text: Column) -> Column:
    """The words with one space before, between and after them; two spaces if there is none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, BETWEEN_WORDS, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


#: More words than any detection has.
STRETCH = 64

FINDING = "struct<label:string,priority:int,weight:double,base:boolean,first:bigint,end:bigint>"


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _matches(words: str, number: int, rule: Rule) -> str:
    # The space before a match belongs to it, so the search can begin at spaces; the one after is left to the next.
    pattern = _quoted(f" (?:{rule.pattern})(?= )")
    split = f"case when size(own) > 0 then split({words}, {pattern}, -1) end"
    one = f"named_struct('rule', {number}, 'found', own, 'between', {split})"
    return f"get(transform(array(regexp_extract_all({words}, {pattern}, 0)), own -> {one}), 0)"


def _passes(groups: tuple[tuple[str, ...], ...]) -> str:
    return " and ".join(f"arrays_overlap(held, array({', '.join(map(_quoted, keys))}))" for keys in groups)


def findings(words: str, ruleset: list[Rule]) -> Column:
    """All detections of all rules of which the words, a column, hold a key.

    Patterns are literals, so each is compiled once. The expression is written as SQL: hundreds of rules take too long to
    put together call by call.
    """
    words = f"`{words}`"
    gates: dict[tuple[tuple[str, ...], ...], list[int]] = {}
    for number, rule in enumerate(ruleset):
        gates.setdefault(gate(rule, ruleset), []).append(number)
    unmatched = "cast(array() as array<struct<rule:int,found:array<string>,between:array<string>>>)"
    tried = [
        f"case when {_passes(groups)} then array({', '.join(_matches(words, n, ruleset[n]) for n in numbers)}) else {unmatched} end"
        for groups, numbers in gates.items()
    ]
    held = f"array_distinct(regexp_extract_all({words}, {_quoted(key_pattern(all_keys(ruleset)))}, 1))"
    of_groups = f"flatten(array({', '.join(tried) or unmatched}))"
    matched = F.expr(f"filter(get(transform(array({held}), held -> {of_groups}), 0), m -> size(m.found) > 0)")
    facts = [
        f"named_struct('label', {_quoted(r.label)}, 'priority', {r.priority}, 'weight', {r.weight}D, 'base', {str(r.base).lower()})" for r in ruleset
    ]
    table = F.expr(f"array({', '.join(facts)})")

    def detections(m: Column) -> Column:
        rule = F.get(table, m["rule"])
        return F.transform(
            placed(m, spaces),
            lambda p: F.struct(
                rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight"), rule["base"].alias("base"),
                p["start"].alias("first"), p["end"].alias("end"),
            ),
        )

    return F.flatten(F.transform(matched, detections))


def scan_licenses(docs: DataFrame, text: str = "text", ruleset: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, found (all detections), kept (those not suppressed), labels and score.

    Words are runs of digits, a-z (A-Z lower-cased) and characters outside ASCII. A detection covers the
    words from ``first`` up to ``end``. One that lies within another of higher priority, or within a longer one
    of the same, is suppressed, and so is one of the same interval and priority as another whose label comes first.
    ``labels`` are those of the detections kept and of all base rules, distinct and sorted; ``score`` is the
    largest weight among them, 0 without any.

    * Null and empty texts have no words and no detections.
    * Rows are judged each for itself; an empty table gives an empty table.
    * Columns of those names are replaced; others stay as they are.
    """
    ruleset = rules() if ruleset is None else ruleset
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "found", "kept", "labels", "score")]
    own = marker(docs, "words")
    whole = docs.select(*rest, normal_words(F.col(text)).alias(own))
    words = F.col(own)
    gated = F.regexp_like(words, F.lit(key_pattern(first_keys(ruleset))))
    nothing = F.expr(f"cast(array() as array<{FINDING}>)")
    detected = whole.withColumn("n_words", F.when(words == "  ", 0).otherwise(spaces(words) - 1)).withColumn(
        "found", F.when(gated, findings(own, ruleset)).otherwise(nothing)
    )

    def stronger(one, other):
        same = (one["first"] == other["first"]) & (one["end"] == other["end"])
        within = (other["first"] <= one["first"]) & (one["end"] <= other["end"])
        even = (other["priority"] == one["priority"]) & (~same | (other["label"] < one["label"]))
        return within & ((other["priority"] > one["priority"]) | even)

    def standing_ones(buckets):
        before = lambda i: F.coalesce(F.get(buckets, i - 1), nothing)
        free = lambda one, others: ~F.exists(others, lambda other: stronger(one, other))
        return F.flatten(
            F.transform(buckets, lambda own, i: F.filter(own, lambda one: free(one, own) & free(one, before(i))))
        )

    found = F.col("found")
    # No detection has STRETCH words, so what one lies within begins in its own stretch of words or the one before.
    stretches = F.sequence(F.lit(0), F.floor(F.col("n_words") / STRETCH).cast("int"))
    by_stretch = F.transform(stretches, lambda b: F.filter(found, lambda f: F.floor(f["first"] / STRETCH) == b))
    kept = F.when(F.size(found) < 2, found).otherwise(let(by_stretch, standing_ones))
    labelled = F.filter(found, lambda f: f["base"])
    judged = detected.drop(own).withColumn("kept", kept)
    standing = F.concat(F.col("kept"), labelled)
    return judged.withColumn("labels", F.array_sort(F.array_distinct(F.transform(standing, lambda f: f["label"])))).withColumn(
        "score", F.coalesce(F.array_max(F.transform(standing, lambda f: f["weight"])), F.lit(0.0))
    )
