"""Licence scans by sentence rules.

Texts are cut into sentences (at sentence marks before white space or a line
end, blank lines and list items), so hard-wrapped lines are joined, also behind
comment marks; each line of a wrapped sentence is a candidate too.  Sentences
are normalised, the parts that differ from text to text (holders' names) put
into one form, and looked up among known licence sentences; the sequence of
sentence identifiers of a document is matched against ordered rules.  Every
licence of an SPDX expression is an identifier of its own.  A rule holds if its identifiers occur in its order; a rule that
is part of a longer rule that also holds is not reported.

All steps are DataFrame operations.  The sentence and rule tables are fixed and
small (a few hundred rows by rule below), so they are broadcast; documents are
never shuffled, only their few known sentences are.

Defined cases: null or empty text -> no licences; repeated sentences count once
each time; repeated document ids are told apart by text hash and equal rows
give equal results; empty tables work; further columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, in normal form.
_MIT = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
     "software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but "
     "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
]
_ISC = [
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
]
_BSD = [
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions "
     "and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions "
     "and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission"),
]
_APACHE = [
    ("apache-2-short", "licensed under the apache license version 2 0"),
    ("apache-2-header", "licensed under the apache license version 2 0 the license"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-short", "this project is licensed under the apache license 2 0"),
]
_OTHER = [
    ("mpl-2-header", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("epl-1-header", "this program and the accompanying materials are made available under the terms of the eclipse public "
     "license v1 0"),
    ("epl-2-header", "this program and the accompanying materials are made available under the terms of the eclipse public "
     "license v 2 0"),
    ("epl-2-header", "this program and the accompanying materials are made available under the terms of the eclipse public "
     "license 2 0"),
    ("epl-2-header", "this program and the accompanying materials are made available under the terms of the eclipse public "
     "license v2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights "
     "to this work"),
    ("all-rights", "all rights reserved"),
]
# Names of licences in notices and rules.
_GNU = {"general public license": "gpl", "lesser general public license": "lgpl",
        "affero general public license": "agpl"}
_NAMED = {"mit license": "mit", "isc license": "isc", "bsd 2 clause license": "bsd-2", "bsd 3 clause license": "bsd-3",
          "apache license 2 0": "apache-2", "apache license version 2 0": "apache-2", "mozilla public license 2 0": "mpl-2",
          "mozilla public license version 2 0": "mpl-2", "boost software license version 1 0": "boost-1",
          "eclipse public license 1 0": "epl-1", "eclipse public license 2 0": "epl-2", "zlib license": "zlib"}
# Versions of the GNU licences that were published.
_GNU_VERSIONS = {"gpl": ("1", "2", "3"), "lgpl": ("2 1", "3"), "agpl": ("3",)}
_CC = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
_OPENING = ["released under the", "licensed under the", "distributed under the", "this work is licensed under the",
            "this project is licensed under the", "this software is released under the"]
# What a notice speaks of.
_THING = ["file", "code", "software", "program", "library", "package", "module", "project", "work", "source code"]
#: Parts of sentences that differ from text to text, and the form that is known.
_FORMS = (
    (r"^neither the names? of .{1,200}? n?or the names of (?:its|their|any|the) contributors may be used",
     "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^neither the names? of .{1,200}? may be used to endorse",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"^(.*eclipse public license (?:v ?)?[12] 0) which .*$", "$1"),
)
#: An SPDX expression behind its tag, and an identifier in it (not the exception behind a WITH).
_SPDX_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_SPDX = (rf"(?i:SPDX-License-Identifier):[ \t]*(\(*{_SPDX_ID}(?:\)*[ \t]+(?:OR|AND|WITH)[ \t]+\(*{_SPDX_ID})*)")


def sentences() -> list[tuple[str, str]]:
    """(normal sentence, identifier) of all known sentences."""
    out = {s: i for i, s in _MIT + _ISC + _BSD + _APACHE + _OTHER}
    openings = _OPENING + [f"this {thing} is {how} under the" for thing in _THING for how in ("licensed", "released", "distributed")]
    for opening, (name, key) in product(openings, _NAMED.items()):
        out.setdefault(f"{opening} {name}", f"{key}-short")
        out.setdefault(f"{opening} terms of the {name}", f"{key}-short")
    for name, key in _NAMED.items():                    # a title
        out.setdefault(name, f"{key}-short")
        out.setdefault(f"the {name}", f"{key}-short")
    for opening, key in product(openings, _GNU_VERSIONS):
        for version in _GNU_VERSIONS[key]:
            for form in (f"v{version}", f"version {version}", version):
                for name in (f"gnu {key} {form}", f"{key} {form}"):
                    out[f"{opening} {name}"] = f"{key}-{version.replace(' ', '.')}-short"
                    out[f"{opening} {name} or later"] = f"{key}-{version.replace(' ', '.')}-plus-short"
            out[f"{opening} {key}v{version}"] = f"{key}-{version.replace(' ', '.')}-short"
    terms = "redistribute it and or modify it under the terms of the gnu"
    by = "as published by the free software foundation"
    for name, key in _GNU.items():
        out[f"you can {terms} {name} {by}"] = f"{key}-grant"
        for version in _GNU_VERSIONS[key]:
            dotted = version.replace(" ", ".")
            out[f"you can {terms} {name} version {version} {by}"] = f"{key}-{dotted}-short"
            out[f"either version {version} of the license or at your option any later version"] = f"gnu-{dotted}-plus"
            out[f"version {version} of the license"] = f"gnu-{dotted}-only"
    for opening, (name, key), version in product(openings, _GNU.items(), (1, 2, 3)):
        out[f"{opening} gnu {name} version {version}"] = f"{key}-{version}-short"
        out[f"{opening} gnu {name} v{version}"] = f"{key}-{version}-short"
        out[f"{opening} gnu {name} version {version} or later"] = f"{key}-{version}-plus-short"
    for opening, kind, version in product(_OPENING, _CC, _CC_VERSIONS):
        key = f"cc-{kind.replace(' ', '-')}-{version.replace(' ', '.')}-short"
        out[f"{opening.removesuffix(' the')} cc {kind} {version}"] = key
    return sorted(out.items())


def rules() -> list[tuple[str, str, str]]:
    """(rule, licence, identifiers in order, joined by '|')."""
    named = [("mit-text", "MIT", "mit-grant|mit-notice|mit-warranty"), ("isc-text", "ISC", "isc-grant"),
             ("bsd-2-text", "BSD-2-Clause", "bsd-grant|bsd-source|bsd-binary"),
             ("bsd-3-text", "BSD-3-Clause", "bsd-grant|bsd-source|bsd-binary|bsd-endorse"),
             ("apache-2-text", "Apache-2.0", "apache-2-header|apache-2-comply"),
             ("mpl-2-text", "MPL-2.0", "mpl-2-header"), ("epl-1-text", "EPL-1.0", "epl-1-header"),
             ("epl-2-text", "EPL-2.0", "epl-2-header"), ("epl-1-short", "EPL-1.0", "epl-1-short"),
             ("epl-2-short", "EPL-2.0", "epl-2-short"), ("boost-1-short", "BSL-1.0", "boost-1-short"),
             ("zlib-short", "Zlib", "zlib-short"), ("unlicense", "Unlicense", "unlicense"),
             ("cc0", "CC0-1.0", "cc0"), ("mit-short", "MIT", "mit-short"), ("isc-short", "ISC", "isc-short"),
             ("bsd-2-short", "BSD-2-Clause", "bsd-2-short"), ("bsd-3-short", "BSD-3-Clause", "bsd-3-short"),
             ("apache-2-short", "Apache-2.0", "apache-2-short"), ("mpl-2-short", "MPL-2.0", "mpl-2-short")]
    known = sorted({i for _, i in sentences()})
    for key, versions in _GNU_VERSIONS.items():
        for version in versions:
            v = version.replace(" ", ".")
            spdx = f"{key.upper()}-{v if '.' in v else v + '.0'}"
            named += [(f"{key}-{v}-notice", f"{spdx}-or-later", f"{key}-grant|gnu-{v}-plus"),
                      (f"{key}-{v}-only-notice", f"{spdx}-only", f"{key}-grant|gnu-{v}-only")]
    for i in known:
        if i.startswith(("gpl-", "lgpl-", "agpl-")) and i.endswith("-short"):
            base, later = i.removesuffix("-short"), i.endswith("-plus-short")
            family, version = base.removesuffix("-plus").rsplit("-", 1)
            version = version if "." in version else f"{version}.0"
            named.append((i, f"{family.upper()}-{version}-{'or-later' if later else 'only'}", i))
        elif i.startswith("cc-"):
            named.append((i, i.removesuffix("-short").upper(), i))
    return named


#: Words of which every known sentence holds one; texts without them have no known sentence.
ANCHORS = r"(?i)licen[sc]e|permi|endorse|gpl|\bcc\W+by\b|redistribut|warrant|public\W+domain|unencumbered|waived|copyright|reserved|compliance|permission"


def normal(col):
    """Lower case, comment marks and punctuation to spaces, one space between words."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


#: End of a sentence, while a text is cut.
_END = "\x01"
#: Steps of cutting (pattern, replacement); line ends that are left are within a sentence.  Comment marks are lines'
#: leading punctuation, which ``normal`` drops; those made of letters go here.
_CUTS = (
    (r"\r\n?", "\n"),
    (r"\n[ \t]*+(?:dnl|rem|REM)(?=[ \t\n])", "\n"),
    (r"\n(?=[^\p{L}\p{N}\n]*+\n)", _END),                                             # a blank line
    (r"(?:^|(?<=[\n\x01]))[^\p{L}\p{N}\n\x01(]*+\(?(?:\d{1,2}[.)]|[a-zA-Z]\)|[ivx]{2,4}\))(?=[ \t])", _END),
    (r"\n(?=[ \t]*+(?:(?://+|#+|;+|\*|%+)[ \t]++[-+*\u2022]|[-+\u2022])[ \t])", _END),
    # not within a holder's name: "Some Inc. nor the names of its contributors"
    (r"(?<![Ii]dentifier:)(?<![^\p{L}][vV]\.)(?<=[.!?:;])(?!(?<=[^\p{L}](?:Inc|Ltd|Corp|Co)\.)[^\p{L}\x01]{1,9}[a-z])"
     r"(?:[ \t]*+\n|[ \t]+)", _END),
)


def _form(sentence):
    for pattern, to in _FORMS:
        sentence = F.regexp_replace(sentence, F.lit(pattern), F.lit(to))
    return sentence


def sentence_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, th, ids, places): the known sentences of each document that has some, in text order."""
    spark = docs.sparkSession
    known = spark.createDataFrame(sentences(), "sentence string, id string")
    text = F.translate("text", _END, " ")
    for pattern, to in _CUTS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    lines = F.split("whole", r"\n")
    # a sentence, and its lines if it has several
    cut = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .where(F.col("text").rlike(ANCHORS))
           .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(text, _END)).alias("number", "whole"))
           .where(F.col("whole").rlike(ANCHORS))
           .select("doc_id", "th", "number", F.posexplode(F.concat(
               F.array("whole"), F.when(F.size(lines) > 1, lines).otherwise(F.expr("cast(array() as array<string>)"))))
               .alias("line", "s"))
           .where(F.col("s").rlike(ANCHORS))
           .select("doc_id", "th", (F.col("number").cast("long") * (1 << 32) + F.greatest(F.col("line") - 1, F.lit(0)))
                   .alias("place"), "s", _form(normal(F.col("s"))).alias("sentence")))
    found = cut.join(F.broadcast(known), "sentence").select("doc_id", "th", "place", "id")
    named = F.regexp_extract_all(F.regexp_replace(F.regexp_extract("s", _SPDX, 1), r"[ \t]+WITH[ \t]+\(*\S+", ""),
                                 F.lit(_SPDX_ID), 0)
    spdx = (cut.where(F.col("s").rlike(_SPDX)).select("doc_id", "th", "place", F.explode(named).alias("id"))
            .where(~F.col("id").isin("OR", "AND")).withColumn("id", F.concat(F.lit("spdx:"), "id")))
    found = found.unionByName(spdx).distinct()
    return (found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("s"))
            .select("doc_id", "th", F.col("s.id").alias("ids"), F.col("s.place").alias("places")))


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, ids, places, rules, licences) of the documents with known sentences."""
    spark = docs.sparkSession
    table = (spark.createDataFrame(rules(), "rule string, licence string, seq string")
             .withColumn("head", F.substring_index("seq", "|", 1)))
    seqs = sentence_ids(docs).withColumn("line", F.concat(F.lit("|"), F.concat_ws("|", "ids"), F.lit("|")))
    heads = seqs.select("*", F.explode(F.array_distinct("ids")).alias("head"))
    # '|a|b|' in order with anything between: the rule's identifiers quoted and parted by \|(?:.*\|)?
    pattern = F.concat(F.lit(r"\|\Q"), F.regexp_replace("seq", r"\|", r"\\E\\|(?:.*\\|)?\\Q"), F.lit(r"\E\|"))
    holds = F.when(F.rlike("line", pattern), F.struct("rule", "licence", "seq"))
    held = (heads.join(F.broadcast(table), "head", "left").groupBy("doc_id", "th")
            .agg(F.first("ids").alias("ids"), F.first("places").alias("places"), F.collect_set(holds).alias("held")))
    # an SPDX identifier names its licence itself
    named = F.transform(F.array_distinct(F.filter("ids", lambda i: i.startswith("spdx:"))), lambda i: F.struct(
        i.alias("rule"), F.substring(i, 6, 200).alias("licence"), i.alias("seq")))
    held = held.withColumn("held", F.concat("held", named))
    top = F.filter("held", lambda r: ~F.exists("held", lambda o: (o["seq"] != r["seq"]) & o["seq"].startswith(
        F.concat(r["seq"], F.lit("|")))))
    return held.select("doc_id", "th", "ids", "places",
                       F.sort_array(F.transform(top, lambda r: r["rule"])).alias("rules"),
                       F.array_sort(F.array_distinct(F.transform(top, lambda r: r["licence"]))).alias("licences"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence sentences, the rules that hold and the licences named."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).alias("d")
    found = licences(docs).alias("f")
    none = F.expr("cast(array() as array<string>)")
    return (all_.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left")
            .select("d.doc_id", F.coalesce(F.size("f.ids"), F.lit(0)).alias("n_sentences"),
                    F.coalesce("f.ids", none).alias("sentence_ids"), F.coalesce("f.rules", none).alias("rules"),
                    F.coalesce("f.licences", none).alias("licences")))
