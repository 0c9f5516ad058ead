"""License scans by ordered signature rules, in DataFrame functions only.

Texts are lower-cased (A-Z) and reduced to words joined by single spaces, so a signature is a regex over
words. A text is cut into words only if it holds a stem that some signature needs. In such a text, each
keyword found opens its rules: a keyword is a literal of its rule's own, which every string that the regex
matches contains, so few regexes run on a text, however many there are. A detection is an interval of
words. One that another of higher priority contains, or a longer one of equal priority, is suppressed; of
equal intervals and priorities the first rule stays.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, row_key, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word before A-Z are lower-cased
#: Phrases whose places are counted, and their labels, which no rule suppresses.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Priorities: identifiers, full names with a version, names, short names and notices.
TAG, FULL, NAME, NOTE = 4, 3, 2, 1
WEIGHT = {TAG: 1.0, FULL: 0.9, NAME: 0.7, NOTE: 0.4}
#: Stems one of which every signature needs, and a pair of words; a text without any has no detection.
STEMS = (
    "licen", "copyright", "copyleft", "reserved", "creative", "cc0", "spdx", "domain", "proprietary", "confidential",
    "warrant", "gpl", "wtfpl", "redistribut", "hereby", "liable", "trademark", "attribution", "endorse", "advertis", "unauthori", "lizenz",
)
STEM_PAIR = rf"(?i)cc{SEPARATORS}by"

_V = r"(?: software)?(?: licen[cs]es?)?(?: agreement)?(?: version)?(?: v ?| ){v}"
_L = r" licen[cs]es?"
#: label, name as regex over words, versions (each a label's ending and its words)
FAMILIES = [
    ("apache", r"apache", ("1.0", "1.1", "2.0")),
    ("mpl", r"mozilla public", ("1.0", "1.1", "2.0")),
    ("npl", r"netscape public", ("1.0", "1.1")),
    ("epl", r"eclipse public", ("1.0", "2.0")),
    ("cpl", r"common public", ("1.0",)),
    ("ipl", r"ibm public", ("1.0",)),
    ("cddl", r"common development and distribution", ("1.0", "1.1")),
    ("eupl", r"european union public", ("1.0", "1.1", "1.2")),
    ("artistic", r"artistic", ("1.0", "2.0")),
    ("afl", r"academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", r"open software", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("ofl", r"(?:sil )?open font", ("1.0", "1.1")),
    ("odbl", r"open (?:data commons open )?database", ("1.0",)),
    ("odc-by", r"open data commons attribution", ("1.0",)),
    ("php", r"php", ("3.0", "3.01")),
    ("zpl", r"zope public", ("1.1", "2.0", "2.1")),
    ("lppl", r"latex project public", ("1.0", "1.1", "1.2", "1.3a", "1.3c")),
    ("cecill", r"cecill(?: free software)?", ("1.0", "1.1", "2.0", "2.1")),
    ("bsl", r"business source", ("1.1",)),
    ("sspl", r"server side public", ("1.0",)),
    ("elastic", r"elastic", ("1.0", "2.0")),
    ("boost", r"boost software", ("1.0",)),
    ("python", r"(?:python|psf)(?: software foundation)?", ("2.0", "2.0.1")),
    ("apsl", r"apple public source", ("1.0", "1.1", "1.2", "2.0")),
    ("rpl", r"reciprocal public", ("1.1", "1.5")),
    ("cpal", r"common public attribution", ("1.0",)),
    ("ecl", r"educational community", ("1.0", "2.0")),
    ("efl", r"eiffel forum", ("1.0", "2.0")),
    ("lpl", r"lucent public", ("1.0", "1.02")),
    ("qpl", r"q public", ("1.0",)),
    ("spl", r"sun public", ("1.0",)),
    ("ngpl", r"nethack general public", ()),
    ("mulan", r"mulan (?:psl|permissive software)", ("1.0", "2.0")),
    ("parity", r"parity public", ("6.0.0", "7.0.0")),
    ("polyform", r"polyform (?:noncommercial|small business|shield)", ("1.0.0",)),
    ("upl", r"universal permissive", ("1.0",)),
    ("osl-community", r"community data", ("1.0", "2.0")),
]
#: One signature each: label, priority, keyword, regex.
SINGLE = [
    ("mit", FULL, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", NAME, "license", r"(?:the )?(?:mit|expat|x11) license"),
    ("isc", NAME, "license", r"(?:the )?isc license"),
    ("zlib", NAME, "license", r"(?:zlib|libpng|zlib libpng) license"),
    ("bsd-2-clause", FULL, "license", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) license"),
    ("bsd-3-clause", FULL, "license", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) license"),
    ("bsd-4-clause", FULL, "license", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd) license"),
    ("bsd", NAME, "licen", r"(?:0bsd|bsd|bsd style) licen[cs]es?"),
    ("bsd", FULL, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("unlicense", NAME, "unlicense", r"unlicense"),
    ("wtfpl", NAME, "wtfpl", r"wtfpl"),
    ("ms-pl", NAME, "license", r"microsoft public license"),
    ("ms-rl", NAME, "license", r"microsoft reciprocal license"),
    ("ncsa", NAME, "license", r"(?:university of illinois )?ncsa open source license"),
    ("openssl", NAME, "license", r"openssl license"),
    ("ruby", NAME, "license", r"ruby license"),
    ("json", NAME, "license", r"json license"),
    ("beerware", NAME, "license", r"beer ?ware license"),
    ("pddl", NAME, "license", r"(?:open data commons )?public domain dedication and license"),
    ("public-domain", NAME, "public domain", r"(?:placed |dedicated |released |is |are )(?:in|into|to) the public domain"),
    ("public-domain", NOTE, "public domain", r"public domain"),
    ("copyleft", NOTE, "copyleft", r"copyleft"),
    ("cc0", NAME, "cc0", r"cc0(?: 1 0)?"),
    ("copyright", NOTE, "copyright", r"copyright(?: c| ©)?(?: 19[0-9][0-9]| 20[0-9][0-9])+(?: 19[0-9][0-9]| 20[0-9][0-9])*"),
    ("copyright", NOTE, "copyright", r"copyright(?: c| ©) (?:by )?[^ ]+"),
    ("proprietary", NAME, "proprietary", r"proprietary and confidential"),
    ("proprietary", NAME, "confidential", r"confidential and proprietary"),
    ("proprietary", NOTE, "proprietary", r"proprietary (?:software|license|information)"),
    ("no-warranty", NOTE, "warranty", r"without (?:any )?warranty"),
    ("no-warranty", NOTE, "warranty", r"as is without warranty of any kind"),
    ("creative-commons", NOTE, "creative commons", r"creative commons(?: license| licence)?"),
    ("licensed", NOTE, "licensed", r"licensed under(?: the)?(?: terms of)?"),
    ("licensed", NOTE, "license", r"(?:see|under|under the|terms of the) license"),
    ("all-rights", NOTE, "reserved", r"(?:some|no) rights reserved"),
    ("mit-0", FULL, "mit no attribution", r"mit no attribution(?: license)?"),
    ("mit", NOTE, "substantial portions", r"shall be included in all copies or substantial portions of the software and this copyright notice"),
    ("mit", NOTE, "permission notice shall be included", r"copyright notice and this permission notice shall be included in all copies"),
    ("isc", FULL, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", FULL, "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("apache-2.0", NOTE, "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", NOTE, "distributed on an as is basis", r"distributed under the license is distributed on an as is basis"),
    ("gpl", NOTE, "you can redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", NOTE, "you can redistribute it", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", NOTE, "you can redistribute it", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("bsd", NOTE, "neither the name", r"neither the name of [^ ]+(?: [^ ]+)? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", NOTE, "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", FULL, "this software is provided as is without", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", FULL, "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0", FULL, "cc0", r"cc0 1 0 universal"),
    ("cc0", NAME, "creative commons zero", r"creative commons zero(?: v?1 0)?"),
    ("public-domain", NAME, "public domain mark", r"public domain mark(?: 1 0)?"),
    ("public-domain", NAME, "no known copyright", r"no known copyright restrictions"),
    ("bsl-1.0", FULL, "boost software", r"boost software license version 1 0"),
    ("postgresql", NAME, "postgresql licen", r"postgresql licen[cs]e"),
    ("curl", NAME, "curl licen", r"curl licen[cs]e"),
    ("x11", NAME, "x consortium", r"x consortium licen[cs]e"),
    ("libpng", FULL, "png reference library", r"png reference library licen[cs]e"),
    ("ijg", NAME, "independent jpeg group", r"independent jpeg group licen[cs]e"),
    ("ftl", NAME, "freetype", r"(?:the )?freetype (?:project )?licen[cs]e"),
    ("vim", NAME, "vim licen", r"vim licen[cs]e"),
    ("tcl", NAME, "tcl tk licen", r"tcl tk licen[cs]e"),
    ("w3c", NAME, "w3c software", r"w3c software (?:notice and )?licen[cs]e"),
    ("unicode", NAME, "unicode", r"unicode (?:terms of use )?licen[cs]e(?: agreement)?"),
    ("icu", NAME, "icu licen", r"icu licen[cs]e"),
    ("blueoak", FULL, "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("artistic-perl", NAME, "same terms as perl", r"licensed under the same terms as perl(?: itself)?"),
    ("watcom", NAME, "sybase open watcom", r"sybase open watcom public licen[cs]e"),
    ("sleepycat", NAME, "sleepycat", r"sleepycat licen[cs]e"),
    ("oracle", NAME, "oracle", r"oracle (?:free use terms and conditions|technology network) licen[cs]e(?: agreement)?"),
    ("intel", NAME, "intel", r"intel (?:open source|simplified software) licen[cs]e"),
    ("nvidia", NAME, "nvidia", r"nvidia (?:software|source code) licen[cs]e(?: agreement)?"),
    ("commons-clause", NAME, "commons clause", r"commons clause licen[cs]e(?: condition)?"),
    ("confluent", NAME, "confluent community", r"confluent community licen[cs]e(?: agreement)?"),
    ("timescale", NAME, "timescale", r"timescale licen[cs]e"),
    ("redis-sal", NAME, "redis source available", r"redis source available licen[cs]e"),
    ("responsible-ai", NAME, "responsible ai", r"(?:open )?responsible ai licen[cs]es?"),
    ("cdla-permissive", NAME, "community data license agreement permissive", r"community data license agreement permissive"),
    ("cdla-sharing", NAME, "community data license agreement sharing", r"community data license agreement sharing"),
    ("ogl-uk", NAME, "open government licen", r"open government licen[cs]e(?: v?[123] 0)?"),
    ("ogl-canada", NAME, "open government licence canada", r"open government licence canada"),
    ("dl-de", NAME, "datenlizenz", r"datenlizenz deutschland (?:namensnennung|zero) 2 0"),
    ("etalab", NAME, "licence ouverte", r"licence ouverte(?: open licence)?"),
    ("fdl-invariant", NOTE, "invariant sections", r"with no invariant sections no front cover texts and no back cover texts under the gnu free documentation license"),
    ("patent-grant", NOTE, "patent licen", r"(?:perpetual |worldwide |royalty free |irrevocable )*patent licen[cs]e"),
    ("no-liability", NOTE, "be liable", r"in no event shall (?:the )?(?:authors?|copyright holders?)(?: or copyright holders?)? be liable"),
    ("no-liability", NOTE, "liable for any", r"liable for any (?:claim|direct|damages)"),
    ("merchantability", NOTE, "merchantability", r"implied warrant(?:y|ies) of merchantability(?: and| or)?(?: fitness for a particular purpose)?"),
    ("trademark", NOTE, "trademark", r"(?:registered )?trademarks? of (?:their|its) respective owners?"),
    ("non-commercial", NOTE, "non commercial use only", r"licensed for non commercial use only"),
    ("eula", NOTE, "end user licen", r"end user licen[cs]e agreement"),
    ("sublicense", NOTE, "sublicen", r"(?:to )?(?:use copy modify merge publish distribute )?sublicen[cs]e and or sell copies of the software"),
    ("reuse", NOTE, "spdx filecopyrighttext", r"spdx filecopyrighttext(?: [^ ]+)?"),
    ("proprietary", NOTE, "unauthorized", r"unauthorized copying of this (?:file|software) via any medium is strictly prohibited"),
    ("trade-secret", NOTE, "trade secret", r"(?:confidential|proprietary)(?: and)? trade secrets?"),
]


def _words(version: str) -> str:
    return version.replace(".", " ")


def _literal(name: str) -> str:
    """The longest text that all that ``name`` matches contains, as far as it stands outside of groups."""
    return max(re.split(r"\(\?:[^()]*\)\??", name), key=len).strip() or "licen"


def signatures() -> list[tuple[str, int, str, str]]:
    """All rules in order: label, priority, keyword, regex over words."""
    out = []
    for label, name, versions in FAMILIES:
        key = _literal(name)
        for v in versions:
            out.append((f"{label}-{v}", FULL, key, name + _V.format(v=_words(v)).replace("(?: licen[cs]es?)?", _L, 1)))
            out.append((f"{label}-{v}", TAG, "spdx", rf"spdx license identifier {label.replace('-', ' ')} {_words(v)}"))
        out.append((label, NAME, key, name + _L))
    gnu = {"gpl": r"(?:gnu )?general public", "lgpl": r"(?:gnu )?(?:lesser|library) general public", "agpl": r"(?:gnu )?affero general public", "gfdl": r"(?:gnu )?free documentation"}
    editions = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3")}
    by = r"(?: as published by the free software foundation)?(?: either)?"
    for label, name in gnu.items():
        key = _literal(name)
        out.append((label, NAME, key, name + _L))
        for v in editions[label]:
            short = rf"(?:{_words(v)}|{v[0]})" if v.endswith(".0") else _words(v)
            out.append((f"{label}-{v}", FULL, key, rf"{name}{_L}{by}(?: version)?(?: v ?| ){short}"))
            out.append((f"{label}-{v}-or-later", FULL, key, rf"{name}{_L}{by}(?: version)?(?: v ?| ){short} or(?: at your option)? any later version"))
            for suffix, ending in (("only", " only"), ("or-later", " or later")):
                out.append((f"{label}-{v}-{suffix}", TAG, "spdx", rf"spdx license identifier {label} {_words(v)}{ending}"))
            if label != "gfdl":
                out.append((f"{label}-{v}", NAME, label, rf"{label} ?v? ?{short}"))
        if label != "gfdl":
            out.append((label, NOTE, label, label))
    for mix, v in product(("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")):
        tag = f"cc-{mix.replace(' ', '-')}-{v}"
        long = mix.replace("by", "attribution").replace("sa", "share ?alike").replace("nc", "non ?commercial").replace("nd", "no ?deriv(?:ative|atives|s)")
        out.append((tag, FULL, "cc by", rf"cc {mix} {_words(v)}"))
        out.append((tag, FULL, "creative commons", rf"creative commons {long} {_words(v)}"))
        out.append((tag, TAG, "creativecommons", rf"creativecommons org licenses {mix} {_words(v)}"))
    for mix in ("by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        out.append((f"cc-{mix.replace(' ', '-')}", NAME, "cc by", f"cc {mix}"))
    return out + SINGLE


def may_match(text):
    """Whether a text holds what some signature needs. Lower-casing more than A-Z only lets more through."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in STEMS]) | text.rlike(STEM_PAIR)


def detections(docs: DataFrame) -> DataFrame:
    """row_key, label, priority, rule, start, end: all places of all rules and base phrases (priority 0
    for these)."""
    rules = signatures() + [(label, 0, phrase, phrase) for phrase, label in BASE.items()]
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(lower, SEPARATORS, " "))
    open_ = docs.where(may_match(F.col("text").cast("string"))).select(row_key().alias("row_key"), F.concat(F.lit(" "), words, F.lit(" ")).alias("line"))
    spark = docs.sparkSession
    table_ = spark.createDataFrame([(k, i, label, p, rf"(?<= )(?=({x})(?= ))") for i, (label, p, k, x) in enumerate(rules)], "keyword string, rule int, label string, priority int, regex string")
    keys = F.array(*[F.lit(k) for k in sorted({k for _, _, k, _ in rules})])
    found = open_.withColumn("keyword", F.explode(F.filter(keys, lambda k: F.contains(F.col("line"), k))))
    found = found.join(F.broadcast(table_), "keyword")  # a few hundred fixed rows
    found = found.withColumn("hits", F.expr("regexp_extract_all(line, regex, 1)")).where(F.size("hits") > 0)
    marked = F.expr("array_remove(split(regexp_replace(line, regex, chr(1)), ' '), '')")
    found = found.select("row_key", "rule", "label", "priority", "hits", marked.alias("marked"))
    starts = F.expr("filter(transform(marked, (w, i) -> if(startswith(w, chr(1)), i, null)), i -> i is not null)")
    found = found.select("row_key", "rule", "label", "priority", F.explode(F.arrays_zip(starts.alias("start"), F.col("hits"))).alias("h"))
    found = found.select("row_key", "rule", "label", "priority", F.col("h.start").cast("long").alias("start"), F.regexp_count("h.hits", F.lit("[^ ]+")).alias("n"))
    return found.select("row_key", "rule", "label", "priority", "start", (F.col("start") + F.col("n")).alias("end")).distinct()


def resolve(found: DataFrame) -> DataFrame:
    """Drop detections that another contains and outranks. In order of start, longest and highest first,
    all that can contain a detection come before it, so running maxima of ends by priority decide."""
    order = W.partitionBy("row_key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in WEIGHT}
    rows = found.where("priority > 0").withColumns({f"reach{p}": x for p, x in reach.items()})
    over = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in WEIGHT], F.lit(-1))
    return rows.where(over < F.col("end")).select("row_key", "rule", "label", "priority", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the highest weight of a detection that stayed, 0 without one).

    docs: ``doc_id``, ``text``; other columns are not read. Null and empty texts have no words and no
    labels (empty strings); null ids and repeated rows are scanned like others; an empty table gives no
    row. What is shuffled are detections and, for each document, its id and number of words.
    """
    found = materialize(detections(docs), "detections")
    stay = resolve(found).select("row_key", "label", "priority")
    base = found.where("priority = 0").select("row_key", "label", "start")
    both = stay.select("row_key", "label", "priority", F.lit(None).cast("long").alias("start")).unionByName(base.withColumn("priority", F.lit(0)))
    is_base = F.col("priority") == 0
    weight = F.coalesce(*[F.when(F.col("priority") == p, F.lit(w)) for p, w in WEIGHT.items()], F.lit(WEIGHT[NAME]))
    sums = both.groupBy("row_key").agg(
        F.count_if(is_base).alias("n_base"),
        F.min("start").alias("first_word"),
        F.max("start").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(weight).alias("score"),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.regexp_count(text, F.lit(WORD_RAW)).cast("long").alias("n_words"))
    return rows.join(sums, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
