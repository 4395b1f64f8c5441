"""License scans by ordered signature rules.

A text becomes its words (ASCII lower case) joined by single spaces. Rules are regular expressions
over whole words with a keyword, a priority and a label; a rule runs only where its keyword occurs,
and no rule runs where no license word occurs. Every match holds its keyword and a license word, so
both only save work. A detection is an interval of words. One that lies
within another gives way to it if the other has the higher priority, or the same and is longer, or
is equal in both and its rule comes first. All of it is built from SQL functions.

Results for odd input: null text is empty and has no words; texts of any length are scanned whole;
repeated rows are scanned each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that always count, with their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: keyword (a start of words in every match); name in words, as a regular expression; SPDX id in words.
FAMILIES = {
    "afl": ("academic free", "academic free licen[cs]e", "afl [123] [0-9]"),
    "agpl": ("affero", "(?:gnu )?affero general public licen[cs]e", "agpl [123] 0"),
    "apache-1.1": ("apache", "apache (?:software )?licen[cs]e(?: version)? v?1 1", "apache 1 1"),
    "apache-2.0": ("apache", "apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?", "apache 2 0"),
    "artistic": ("artistic", "(?:perl )?artistic licen[cs]e(?: v?[12] 0)?", "artistic [12] 0"),
    "beerware": ("beer", "beer ?ware licen[cs]e", "beerware"),
    "blessing": ("blessing", "sqlite blessing", "blessing"),
    "bsd": ("bsd", "(?:modified |new |simplified |free )?bsd(?: [0-4] clause)?(?: style)? licen[cs]e", "bsd [0-4] clause"),
    "bsl": ("business source", "business source licen[cs]e(?: 1 1)?", "busl 1 1"),
    "boost": ("boost", "boost software licen[cs]e", "bsl 1 0"),
    "cc0": ("cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    "cc-by": ("c", "(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?(?: international| unported)?", "cc by [1-4] [05]"),
    "cc-by-nc": ("nc", "cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    "cc-by-nc-nd": ("nd", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    "cc-by-nc-sa": ("sa", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    "cc-by-nd": ("nd", "cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    "cc-by-sa": ("sa", "cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    "cc-nc-text": ("creative commons attribution non", "creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc"),
    "cc-sa-text": ("creative commons attribution share", "creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa"),
    "cddl": ("development and distribution", "common development and distribution licen[cs]e(?: 1 [01])?", "cddl 1 [01]"),
    "cecill": ("cecill", "cecill(?: free software)? licen[cs]e(?: [abc])?", "cecill [12] [01]"),
    "cpal": ("attribution", "common public attribution licen[cs]e", "cpal 1 0"),
    "cpl": ("common public", "common public licen[cs]e", "cpl 1 0"),
    "curl": ("curl", "curl licen[cs]e", "curl"),
    "ecl": ("community", "educational community licen[cs]e", "ecl [12] 0"),
    "efl": ("eiffel", "eiffel forum licen[cs]e", "efl [12] 0"),
    "elastic": ("elastic", "elastic licen[cs]e(?: v?2(?: 0)?)?", "elastic 2 0"),
    "epl": ("eclipse", "eclipse public licen[cs]e(?: v?[12](?: 0)?)?", "epl [12] 0"),
    "edl": ("eclipse", "eclipse distribution licen[cs]e", "edl 1 0"),
    "eupl": ("european union", "european union public licen[cs]e", "eupl 1 [012]"),
    "fair": ("fair", "fair licen[cs]e", "fair"),
    "gfdl": ("documentation", "(?:gnu )?free documentation licen[cs]e", "gfdl 1 [123]"),
    "gpl-1": ("general public", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?1", "gpl 1 0"),
    "gpl-2": ("general public", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2", "gpl 2 0"),
    "gpl-3": ("general public", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3", "gpl 3 0"),
    "gust": ("gust", "gust font licen[cs]e", "gust font license"),
    "hpnd": ("historical", "historical permission notice and disclaimer", "hpnd"),
    "icu": ("icu", "icu licen[cs]e", "icu"),
    "ipa": ("ipa", "ipa font licen[cs]e", "ipa"),
    "ipl": ("ibm", "ibm public licen[cs]e", "ipl 1 0"),
    "isc": ("isc", "isc licen[cs]e", "isc"),
    "json": ("json", "json licen[cs]e", "json"),
    "lgpl": ("lesser", "(?:gnu )?lesser general public licen[cs]e(?: v(?:ersion )?[23](?: [01])?)?", "lgpl [23] [01]"),
    "lgpl-library": ("library", "(?:gnu )?library general public licen[cs]e", "lgpl 2 0"),
    "libpng": ("libpng", "libpng licen[cs]e", "libpng"),
    "lppl": ("latex", "latex project public licen[cs]e", "lppl 1 [0123]"),
    "mirOS": ("miros", "miros licen[cs]e", "miros"),
    "mit-0": ("mit", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    "mit-license": ("mit", "(?:the )?mit licen[cs]e", "mit"),
    "motosoto": ("motosoto", "motosoto licen[cs]e", "motosoto"),
    "mpl-1.1": ("mozilla", "mozilla public licen[cs]e(?: version)? v?1 [01]", "mpl 1 [01]"),
    "mpl-2.0": ("mozilla", "mozilla public licen[cs]e(?:(?: version)? v?2(?: 0)?)?", "mpl 2 0"),
    "ms-pl": ("microsoft", "microsoft public licen[cs]e", "ms pl"),
    "ms-rl": ("microsoft", "microsoft reciprocal licen[cs]e", "ms rl"),
    "mulan": ("mulan", "mulan (?:psl|permissive software licen[cs]e)", "mulanpsl [12] 0"),
    "ncsa": ("illinois", "university of illinois(?: ncsa)?(?: open source)? licen[cs]e", "ncsa"),
    "nasa": ("nasa", "nasa open source agreement", "nasa 1 3"),
    "odbl": ("database", "open database licen[cs]e", "odbl 1 0"),
    "odc-by": ("commons attribution", "open data commons attribution licen[cs]e", "odc by 1 0"),
    "ofl": ("font", "(?:sil )?open font licen[cs]e", "ofl 1 [01]"),
    "openssl": ("openssl", "openssl licen[cs]e", "openssl"),
    "osl": ("open software", "open software licen[cs]e", "osl [123] 0"),
    "pddl": ("domain dedication", "public domain dedication and licen[cs]e", "pddl 1 0"),
    "php": ("php", "php licen[cs]e", "php 3 01?"),
    "postgresql": ("postgresql", "postgresql licen[cs]e", "postgresql"),
    "psf": ("python", "python software foundation licen[cs]e", "psf 2 0"),
    "qpl": ("public", "q public licen[cs]e", "qpl 1 0"),
    "ruby": ("ruby", "ruby licen[cs]e", "ruby"),
    "sleepycat": ("sleepycat", "sleepycat licen[cs]e", "sleepycat"),
    "sspl": ("server side", "server side public licen[cs]e", "sspl 1 0"),
    "unicode": ("unicode", "unicode licen[cs]e", "unicode dfs 2016"),
    "unlicense": ("unlicense", "(?:the )?unlicense", "unlicense"),
    "upl": ("universal", "universal permissive licen[cs]e", "upl 1 0"),
    "vim": ("vim", "vim licen[cs]e", "vim"),
    "w3c": ("w3c", "w3c(?: software)?(?: notice and)? licen[cs]e", "w3c"),
    "wtfpl": ("wtfpl", "wtfpl", "wtfpl"),
    "x11": ("x11", "x11 licen[cs]e", "x11"),
    "zlib": ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    "zpl": ("zope", "zope public licen[cs]e", "zpl [12] [01]"),
}
#: Sentences of license texts: keyword (as above), expression, label.
TEXTS = (
    ("free of charge", "permission is hereby granted free of charge to any person obtaining a copy", "mit-text"),
    ("redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("or distribute this software", "permission to use copy modify and or distribute this software for any purpose", "isc-text"),
    ("limitations under", "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e", "apache-text"),
    ("free software", "this program is free software you can redistribute it and or modify it", "gpl-text"),
    ("as is", "(?:this|the) software is provided as is without (?:any )?(?:express or implied )?warranty", "as-is"),
    ("public domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain", "public-domain"),
    ("public domain", "this (?:work|software|file) is in the public domain", "public-domain"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
    ("copyright", "copyright(?: c)? [12][0-9]{3}", "copyright-notice"),
    ("proprietary", "proprietary and confidential", "proprietary"),
    ("for non", "for non ?commercial use only", "non-commercial"),
    ("unauthori", "unauthori[sz]ed (?:copying|reproduction|distribution) (?:of this file )?is (?:strictly )?prohibited", "proprietary"),
    ("commercial", "commercial licen[cs]e", "commercial"),
    ("evaluation", "evaluation licen[cs]e", "evaluation"),
    ("dual", "dual licen[cs]ed", "dual"),
)
#: Words of which a text must have one before any rule is tried.
GATE = ("license", "licence", "licensed", "licenced", "licenses", "licences", "copyright", "spdx", "public domain", "warranty", "cc", "cc0", "unlicense", "wtfpl", "rights reserved", "redistribution", "permission", "proprietary", "nasa", "blessing", "commons", "mulan", "free software", "no attribution", "historical permission", "commercial use", "noncommercial use", "prohibited")
GRANT = "(?:licen[cs]ed|released|distributed|available|provided|published|covered|used|governed) (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"


def rules() -> list[tuple[int, int, str, str, str]]:
    """(order, priority, keyword, expression, label): identifiers, then grants, then sentences, then names."""
    found = [(100, "spdx", f"spdx licen[cs]e identifier {spdx}(?: only| or later)?", label) for label, (_, _, spdx) in FAMILIES.items()]
    found += [(90, keyword, f"{GRANT} {name}", label) for label, (keyword, name, _) in FAMILIES.items()]
    found += [(80, keyword, text, label) for keyword, text, label in TEXTS]
    found += [(60, keyword, name, label) for label, (keyword, name, _) in FAMILIES.items()]
    return [(i, priority, keyword, f" ({text})(?= )", label) for i, (priority, keyword, text, label) in enumerate(found)]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


DETECTION = "array<struct<first:int,last:int,priority:int,rank:int,label:string>>"
#: Marks around a match; no word holds them.
OPEN, CLOSE = "\x01", "\x02"


def most_words() -> int:
    """Words that a match can have at most: no expression repeats a space."""
    return max(pattern.count(" ") for _, _, _, pattern, _ in rules())


def _detections(norm: Column) -> Column:
    """array<struct<first,last,priority,rank,label>> of all rules whose keyword occurs.

    Matches are marked in the text, so their places are those of the marked words: linear in the text.
    """
    literal = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern"), F.lit(label).alias("label")) for i, p, k, x, label in rules()])

    def places(words: Column, marked) -> Column:
        return F.array_compact(F.transform(words, lambda w, i: F.when(marked(w), i)))

    def of_words(rule: Column, words: Column) -> Column:
        pairs = F.arrays_zip(places(words, lambda w: F.startswith(w, F.lit(OPEN))).alias("a"), places(words, lambda w: F.endswith(w, F.lit(CLOSE))).alias("b"))
        return F.transform(pairs, lambda p: F.struct((p["a"] - 1).cast("int").alias("first"), (p["b"] - 1).cast("int").alias("last"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label")))

    def of_rule(rule: Column) -> Column:
        marked = F.split(F.regexp_replace(norm, rule["pattern"], F.lit(f" {OPEN}$1{CLOSE}")), " ", -1)
        return F.flatten(F.transform(F.array(marked), lambda words: of_words(rule, words)))

    empty = F.array().cast(DETECTION)
    return F.flatten(F.transform(F.filter(literal, lambda rule: F.contains(norm, F.concat(F.lit(" "), rule["keyword"]))), lambda rule: F.when(F.rlike(norm, rule["pattern"]), of_rule(rule)).otherwise(empty)))


#: Detections that are looked back at, if no more lie within a match's length; else all that can.
NEAR_DETECTIONS = 64
#: Detections of a block.
BLOCK = 256


def _survivors(found: Column) -> Column:
    """Detections that lie in none of a higher key.

    Sorted by start, then by falling end and key, whatever holds a detection stands before it and starts less
    than the longest match earlier, so a detection looks back only at a bounded number of others.
    """
    reach = most_words()
    order = F.sort_array(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("less"), (-d["priority"]).alias("low"), d["rank"].alias("rank"), d["label"].alias("label"))))

    def key(d):
        return F.struct(-d["low"], -d["less"] - d["first"], -d["rank"])

    def stays(all_: Column, back: Column):
        # A slice copies its whole array, so the array is cut into blocks, each with what it looks back at.
        def of_block(b: Column) -> Column:
            before = F.least(back, b * BLOCK)
            return F.flatten(F.transform(F.array(F.slice(all_, b * BLOCK - before + 1, before + BLOCK)), lambda block: of_slice(block, before)))

        def of_slice(block: Column, before: Column) -> Column:
            def one(x, i):
                start = F.greatest(F.lit(0), i - back)
                return (i >= before) & ~F.exists(F.slice(block, start + 1, i - start), lambda y: (y["less"] <= x["less"]) & (key(y) > key(x)))

            return F.filter(block, one)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), of_block))

    def of(all_: Column) -> Column:
        close = F.forall(F.transform(all_, lambda x, i: (i < NEAR_DETECTIONS) | (x["first"] - F.get(all_, i - NEAR_DETECTIONS)["first"] > reach)), lambda ok: ok)
        back = F.when(close, NEAR_DETECTIONS).otherwise(len(rules()) * (reach + 1))
        # Bound as a variable, so that it is worked out once and not for each detection.
        return F.flatten(F.transform(F.array(back), lambda n: stays(all_, n)))

    kept = F.flatten(F.transform(F.array(order), of))
    return F.transform(kept, lambda d: F.struct(d["first"].alias("first"), (-d["less"]).alias("last"), (-d["low"]).alias("priority"), d["rank"].alias("rank"), d["label"].alias("label")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base counts and places, detections (survivors), labels, score for each row."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATOR, " "))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))
    rows = rows.withColumn("n_words", F.when(F.col("norm") == "  ", 0).otherwise(_spaces(F.col("norm")) - 1).cast("long"))
    norm = F.col("norm")
    rows = rows.withColumn("gated", F.rlike(norm, F.lit(" (?:" + "|".join(GATE) + ") ")))
    counts = {label: F.when(F.col("gated"), F.regexp_count(norm, F.lit(f" {phrase}(?= )"))).otherwise(0) for phrase, label in BASE.items()}
    rows = rows.withColumns({f"n_{label}": n for label, n in counts.items()})
    firsts = [F.when(F.col(f"n_{label}") > 0, _spaces(F.substring_index(norm, f" {phrase} ", 1))) for phrase, label in BASE.items()]
    lasts = [F.when(F.col(f"n_{label}") > 0, F.col("n_words") - _spaces(F.substring_index(norm, f" {phrase} ", -1)) - len(phrase.split())) for phrase, label in BASE.items()]
    empty = F.array().cast(DETECTION)
    rows = rows.withColumn("all_detections", F.when(F.col("gated"), _detections(norm)).otherwise(empty))
    rows = rows.withColumn("detections", F.when(F.size("all_detections") > 0, _survivors(F.col("all_detections"))).otherwise(empty))
    base = F.array_compact(F.array(*[F.when(F.col(f"n_{label}") > 0, F.lit(label)) for label in BASE.values()]))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 100.0, F.lit(0.0))
    rows = rows.withColumns({"n_base": sum((F.col(f"n_{label}") for label in BASE.values()), F.lit(0)).cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"), "base": base, "best": best})
    own = F.transform("detections", lambda d: d["label"])
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"), F.greatest(F.col("best"), F.when(F.col("n_base") > 0, 0.6).otherwise(0.0)).alias("score"), "detections"
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
