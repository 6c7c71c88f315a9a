"""License scan: ordered signature rules with a keyword prefilter and containment suppression.

A rule is a regular expression over the normalised text (lower case words, one space between),
with a label, a priority and one keyword that every match contains.  One pass over the raw text
decides whether any keyword occurs; only then is the text normalised, and only rules whose own
keyword occurs are matched.  Detections are word intervals.  A detection contained in another of
the same or a higher priority is suppressed, so "apache license version 2 0" hides "apache
license" and equal intervals keep the higher priority, then the earlier rule.  The base phrases
of the contract are rules too; suppression never removes their labels from the result.

Only DataFrame functions, one map-only stage: nothing is shuffled and a document's work is
bounded by its own text.

Defined results: null, empty and word-less texts have no detection (n_words 0, null positions,
empty labels, score 0); repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii

# fixed by the contract: characters that belong to no word (before and after lower-casing)
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# fixed by the contract: phrase -> label
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

MENTION, NAMED, EXACT = 1, 2, 3  # priorities
WEIGHT = {MENTION: 0.5, NAMED: 0.8, EXACT: 0.95}

_VERSION = r"(?: v| version| ver| v version)?"


def _v(version: str) -> str:
    """'2.0' -> words '2 0', the '.0' optional; also 'v2' as one word."""
    major, _, minor = version.partition(".")
    tail = f" {minor}" if minor and minor != "0" else "(?: 0)?" if minor else ""
    return rf"(?:{_VERSION} {major}| v{major}){tail}"


def _rules() -> list[dict]:
    """The signature table, in order.  Each rule names one literal that every match contains."""
    out: list[tuple[str, str, str, int]] = []  # keyword, pattern, label, priority

    def add(keyword: str, pattern: str, label: str, priority: int) -> None:
        out.append((keyword, pattern, label, priority))

    for phrase, label in BASE.items():
        add(phrase, phrase, label, MENTION)

    # versioned families: label, (keyword, name in words) of each spelling, versions
    versioned = [
        ("gpl", [("general public licen", "(?:gnu )?general public licen[cs]e"), ("gpl", "(?:gnu )?gpl")], "1.0 2.0 3.0"),
        ("lgpl", [("lesser general public licen", "(?:gnu )?lesser general public licen[cs]e"), ("lgpl", "(?:gnu )?lgpl")], "2.0 2.1 3.0"),
        ("agpl", [("affero general public licen", "(?:gnu )?affero general public licen[cs]e"), ("agpl", "(?:gnu )?agpl")], "1.0 3.0"),
        ("gfdl", [("free documentation licen", "(?:gnu )?free documentation licen[cs]e"), ("gfdl", "(?:gnu )?gfdl")], "1.1 1.2 1.3"),
        ("apache", [("apache", "apache (?:software )?licen[cs]e")], "1.0 1.1 2.0"),
        ("mpl", [("mozilla public licen", "mozilla public licen[cs]e"), (" mpl ", "mpl")], "1.0 1.1 2.0"),
        ("epl", [("eclipse public licen", "eclipse public licen[cs]e"), (" epl ", "epl")], "1.0 2.0"),
        ("cddl", [("common development and distribution", "common development and distribution licen[cs]e"), ("cddl", "cddl")], "1.0 1.1"),
        ("cpl", [("common public licen", "common public licen[cs]e")], "1.0"),
        ("eupl", [("european union public licen", "european union public licen[cs]e"), ("eupl", "eupl")], "1.0 1.1 1.2"),
        ("osl", [("open software licen", "open software licen[cs]e")], "1.0 1.1 2.0 2.1 3.0"),
        ("afl", [("academic free licen", "academic free licen[cs]e")], "1.1 1.2 2.0 2.1 3.0"),
        ("artistic", [("artistic licen", "artistic licen[cs]e")], "1.0 2.0"),
        ("bsl", [("boost software licen", "boost software licen[cs]e")], "1.0"),
        ("ofl", [("open font licen", "(?:sil )?open font licen[cs]e")], "1.0 1.1"),
        ("cecill", [("cecill", "cecill(?: [bc])?(?: free software licen[cs]e)?")], "1.0 2.0 2.1"),
        ("php", [("php licen", "php licen[cs]e")], "3.0 3.01"),
        ("psf", [("python ", "python (?:software foundation )?licen[cs]e")], "2.0 2.1"),
        ("zpl", [("zope public licen", "zope public licen[cs]e")], "1.1 2.0 2.1"),
        ("ecl", [("educational community licen", "educational community licen[cs]e")], "1.0 2.0"),
        ("lppl", [("latex project public licen", "latex project public licen[cs]e"), ("lppl", "lppl")], "1.0 1.1 1.2 1.3"),
        ("npl", [("netscape public licen", "netscape public licen[cs]e")], "1.0 1.1"),
        ("spl", [("sun public licen", "sun public licen[cs]e")], "1.0"),
        ("apsl", [("apple public source licen", "apple public source licen[cs]e")], "1.0 1.1 1.2 2.0"),
        ("rpl", [("reciprocal public licen", "reciprocal public licen[cs]e")], "1.1 1.5"),
        ("qpl", [("q public licen", "q public licen[cs]e")], "1.0"),
        ("ms-pl", [("microsoft public licen", "microsoft public licen[cs]e")], "1.0"),
        ("ms-rl", [("microsoft reciprocal licen", "microsoft reciprocal licen[cs]e")], "1.0"),
        ("odbl", [("open database licen", "open database licen[cs]e")], "1.0"),
        ("odc-by", [("open data commons attribution", "open data commons attribution licen[cs]e")], "1.0"),
        ("upl", [("universal permissive licen", "universal permissive licen[cs]e")], "1.0"),
        ("ogl", [("open government licen", "open government licen[cs]e")], "1.0 2.0 3.0"),
        ("mulan-psl", [("mulan p", "mulan (?:psl|permissive software licen[cs]e)")], "1.0 2.0"),
        ("cc0", [("cc0", "cc0"), ("creative commons zero", "creative commons zero")], "1.0"),
    ]
    later = "(?: or (?:at your option )?(?:any )?later(?: version)?)"
    for label, names, versions in versioned:
        for keyword, name in names:
            for version in versions.split():
                add(keyword, name + _v(version), f"{label}-{version}", EXACT)
                if label in ("gpl", "lgpl", "agpl", "gfdl"):
                    add(keyword, name + _v(version) + later, f"{label}-{version}-or-later", EXACT)
                    add(keyword, name + _v(version) + " only", f"{label}-{version}-only", EXACT)
            add(keyword, name, label, NAMED)
        for version in versions.split():
            major, _, minor = version.partition(".")
            add(f"spdx license identifier {label.replace('-', ' ')}",
                f"spdx license identifier {label.replace('-', ' ')} {major}(?: {minor})?", f"{label}-{version}", EXACT)

    spoken = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
    for parts in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        label = "cc-" + parts.replace(" ", "-")
        words = " ".join(spoken[p] for p in parts.split())
        add(f"cc {parts} ", f"cc {parts}", label, NAMED)
        add("creative commons attribution", f"creative commons {words}(?: (?:international|unported|generic))?(?: licen[cs]e)?", label, NAMED)
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(f"cc {parts} ", f"cc {parts}{_v(version)}", f"{label}-{version}", EXACT)
            add("creative commons attribution", f"creative commons {words}{_v(version)}(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?", f"{label}-{version}", EXACT)

    for clauses, number in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        label = f"bsd-{clauses}-clause"
        add("bsd", f"bsd {clauses} clause", label, EXACT)
        add("clause bsd", f"(?:{clauses}|{number}) clause bsd(?: licen[cs]e)?", label, EXACT)
    for name, clauses in (("simplified", 2), ("freebsd", 2), ("new", 3), ("revised", 3), ("modified", 3), ("original", 4), ("old", 4)):
        add(f"{name} bsd", f"{name} bsd licen[cs]e", f"bsd-{clauses}-clause", EXACT)
    add("bsd", "bsd(?: style)? licen[cs]e", "bsd", NAMED)

    for name, label in [  # single-version licenses by name
        ("isc", "isc"), ("zlib", "zlib"), ("zlib libpng", "zlib"), ("x11", "x11"), ("curl", "curl"), ("expat", "mit"), ("beerware", "beerware"),
        ("ncsa", "ncsa"), ("illinois open source", "ncsa"), ("sleepycat", "sleepycat"), ("ruby", "ruby"), ("vim", "vim"),
        ("openssl", "openssl"), ("ssleay", "openssl"), ("json", "json"), ("postgresql", "postgresql"), ("unicode", "unicode"),
        ("ibm public", "ipl"), ("intel open source", "intel"), ("jabber open source", "josl"), ("motosoto", "motosoto"),
        ("nokia open source", "nokia"), ("ricoh source code public", "rscpl"), ("w3c software", "w3c"), ("xnet", "xnet"),
        ("open watcom public", "watcom"), ("vovida software", "vsl"), ("frameworx open", "frameworx"),
        ("entessa public", "entessa"), ("attribution assurance", "aal"), ("cua office public", "cua"), ("eiffel forum", "efl"),
        ("lucent public", "lpl"), ("nethack general public", "ngpl"), ("nasa open source", "nasa"), ("simple public", "simpl"),
        ("realnetworks public source", "rpsl"), ("tcl tk", "tcl"), ("clarified artistic", "artistic-clarified"), ("perl", "perl"),
        ("imagemagick", "imagemagick"), ("freetype", "ftl"), ("bitstream vera", "bitstream-vera"), ("libpng", "libpng"),
        ("info zip", "info-zip"), ("ijg", "ijg"), ("what the fuck you want to public", "wtfpl"), ("peer production", "ppl"),
        ("hippocratic", "hippocratic"), ("business source", "busl"), ("server side public", "sspl"), ("elastic", "elastic"),
        ("polyform noncommercial", "polyform-nc"), ("polyform small business", "polyform-sb"), ("responsible ai", "rail"),
        ("open rail", "rail"), ("bigscience rail", "rail"), ("community data", "cdla"), ("blue oak model", "blueoak"),
        ("anti 996", "anti-996"), ("cooperative patent", "cooperative-patent"), ("design science", "dsl"), ("free art", "lal"),
    ]:
        add(f"{name} licen", f"{name} licen[cs]e", label, NAMED)
    for tag, label in [("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("0bsd", "bsd-0-clause"),
                       ("postgresql", "postgresql"), ("ncsa", "ncsa"), ("x11", "x11"), ("curl", "curl")]:
        add(f"spdx license identifier {tag}", f"spdx license identifier {tag}", label, EXACT)

    for keyword, pattern, label in [  # passages of well-known license texts
        ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", "mit"),
        ("without warranty of any kind", "the software is provided as is without warranty of any kind express or implied", "mit"),
        ("permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose", "isc"),
        ("redistributions of source code", "redistributions of source code must retain the above copyright notice", "bsd"),
        ("redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", "bsd"),
        ("names of its contributors", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "bsd-3-clause"),
        ("without any express or implied warranty", "this software is provided as is without any express or implied warranty", "zlib"),
        ("licensed under the apache", "licensed under the apache license", "apache"),
        ("in compliance with the license", "you may not use this file except in compliance with the license", "apache"),
        ("this program is free software", "this program is free software you can redistribute it and or modify it", "gpl"),
        ("this library is free software", "this library is free software you can redistribute it and or modify it", "lgpl"),
        ("terms of the gnu general public", "under the terms of the gnu general public licen[cs]e", "gpl"),
        ("terms of the gnu lesser general", "under the terms of the gnu lesser general public licen[cs]e", "lgpl"),
        ("terms of the gnu affero general", "under the terms of the gnu affero general public licen[cs]e", "agpl"),
        ("terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license", "mpl"),
        ("creative commons", "licensed under (?:a|the) creative commons", "cc"),
        ("the mit licen", "(?:licensed|released|distributed|available) under the mit licen[cs]e", "mit"),
        ("all rights reserved", "all rights reserved", "proprietary"),
        ("proprietary and confidential", "proprietary and confidential", "proprietary"),
        ("to the public domain", "dedicated to the public domain", "public-domain"),
        ("into the public domain", "released into the public domain", "public-domain"),
        ("free and unencumbered software", "this is free and unencumbered software released into the public domain", "unlicense"),
        ("what the fuck", "do what the fuck you want to", "wtfpl"),
        ("as long as you retain this notice", "as long as you retain this notice you can do whatever you want", "beerware"),
        ("commons clause", "commons clause licen[cs]e condition", "commons-clause"),
    ]:
        add(keyword, pattern, label, NAMED)

    return [{"rule": i, "kw": kw, "re": f" {pattern}(?= )", "label": label, "prio": prio, "base": i < len(BASE)}
            for i, (kw, pattern, label, prio) in enumerate(out)]


RULES = _rules()
KEYWORDS = sorted({r["kw"] for r in RULES})
# Gate on the raw text: every keyword contains one of the words, or is found by the pattern.
GATE_WORDS = ("licen", "gpl", "spdx", "copyright", "commons", "bsd", "cddl", "eupl", "cecill", "lppl", "gfdl", "mulan", "cc0",
              "permission", "warranty", "redistribut", "contributors", "software",
              "reserved", "confidential", "domain", "fuck", "retain")
GATE_PATTERN = rf"(?<![0-9a-z])(?:mpl|epl|cc{NON_WORD}+by)(?![0-9a-z])"
_RULE_TYPE = "array<struct<rule:int,kw:string,re:string,label:string,prio:int,base:boolean>>"


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" ")))


def _spans(norm: Column, rule: Column) -> Column:
    """All matches of one rule as (start, end) word intervals with the rule's label."""

    def walk(m: Column) -> Column:
        found, gaps = m["found"], m["gaps"]
        return F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda z, i: let(
                F.struct((z["at"] + _spaces(F.get(gaps, i))).alias("s"), _spaces(F.get(found, i)).alias("n")),
                lambda p: F.struct((p["s"] + p["n"]).alias("at"),
                                   F.concat(z["out"], F.array(F.struct(p["s"].alias("start"), (p["s"] + p["n"]).alias("end")))).alias("out"))),
            lambda z: z["out"])

    spans = let(F.struct(F.regexp_extract_all(norm, rule["re"], F.lit(0)).alias("found"),
                         F.split(norm, rule["re"], -1).alias("gaps")), walk)
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("minus_end"), (-rule["prio"]).alias("minus_prio"), rule["rule"].alias("rule"),
        rule["label"].alias("label"), rule["base"].alias("base")))


def _suppress(found: Column) -> Column:
    """Detections in order of (start, -end, -priority, rule), without those contained in an earlier
    one of at least their priority: a fold with the furthest end seen at each priority."""
    def step(z: Column, d: Column) -> Column:
        end, prio = -d["minus_end"], -d["minus_prio"]
        limit = F.when(prio == 1, z["e1"]).when(prio == 2, z["e2"]).otherwise(z["e3"])
        return F.struct(
            F.greatest(z["e1"], end).alias("e1"),
            F.when(prio >= 2, F.greatest(z["e2"], end)).otherwise(z["e2"]).alias("e2"),
            F.when(prio >= 3, F.greatest(z["e3"], end)).otherwise(z["e3"]).alias("e3"),
            F.when(end > limit, F.concat(z["out"], F.array(d))).otherwise(z["out"]).alias("out"))

    kind = "array<struct<start:int,minus_end:int,minus_prio:int,rule:int,label:string,base:boolean>>"
    start = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.array().cast(kind).alias("out"))
    return F.aggregate(found, start, step, lambda z: z["out"])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, ``found`` (every detection) and ``kept`` (after suppression).

    A detection is (start, minus_end, minus_prio, rule, label, base): a half-open word interval."""
    text = F.col(text_col)
    rules = F.from_json(F.lit(json.dumps(RULES)), _RULE_TYPE)
    keywords = F.array(*[F.lit(k) for k in KEYWORDS])
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), NON_WORD + "+", " ")), F.lit(" "))

    # lower() only opens the gate (it may also fold letters beyond A-Z); matching uses ``norm``
    gate = let(F.lower(text), lambda t: F.exists(F.array(*[F.lit(w) for w in GATE_WORDS]), lambda w: F.contains(t, w))
               | F.rlike(t, F.lit(GATE_PATTERN)))

    def match(norm: Column) -> Column:
        present = F.filter(keywords, lambda k: F.contains(norm, k))
        active = let(present, lambda ks: F.filter(rules, lambda r: F.array_contains(ks, r["kw"]) & F.rlike(norm, r["re"])))
        return F.array_sort(F.flatten(F.transform(active, lambda r: _spans(norm, r))))

    kind = "array<struct<start:int,minus_end:int,minus_prio:int,rule:int,label:string,base:boolean>>"
    return (
        docs.withColumn("n_words", F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("long"))
        .withColumn("found", F.when(gate, let(norm, match)).otherwise(F.array().cast(kind)))
        .withColumn("kept", _suppress(F.col("found")))
    )


def summarize(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base places and labels per document; the score is the strongest kept detection's weight."""
    base = F.filter("found", lambda d: d["base"])
    kept_labels = F.transform("kept", lambda d: d["label"])
    base_labels = F.transform(base, lambda d: d["label"])
    weights = F.transform("kept", lambda d: F.when(d["minus_prio"] == -EXACT, WEIGHT[EXACT])
                          .when(d["minus_prio"] == -NAMED, WEIGHT[NAMED]).otherwise(WEIGHT[MENTION]))
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return scanned.select(
        F.col(id_col), "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).cast("long").alias("last_word"),
        text(base_labels).alias("base_labels"),
        text(F.concat(kept_labels, base_labels)).alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
    )
