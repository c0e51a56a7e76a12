"""License scan by ordered signature rules, with SQL functions only.

A text is reduced to its words (lower-cased, one space between two). Rules are
regular expressions on that form: the hand-written signatures of license bodies, headers and
compact names (``signatures``), and by the families below for each version
of a family an SPDX tag, a licensing notice and the name with its version, and for
each family a notice and the bare name. "Licence" is read as "license". A rule is tried only on
texts that hold its keyword, a word that each of its alternatives must hold; a name
with several spellings has a rule for each such word. The detections of a text are ordered by start, longest
first, higher priority first, and a detection whose interval lies in that of one
kept before is suppressed, so "GNU General Public License, version 3" is one
detection and not three.

The base phrases are counted besides, wherever their words stand consecutively;
their labels always stay.

Defined results: null text counts as empty (no words, empty labels, null places);
very long texts are scanned whole; repeated rows are scanned once each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import query, table
from noisesift.llm.signatures import signatures

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# label, name on normalised words, keyword that gates the alternatives of the name that hold it, versions
FAMILIES = (
    ("apache", "apache(?: software)?(?: public)? license|apache(?= v? ?[12])", "apache", ("1.0", "1.1", "2.0")),
    ("mit", "mit license|mit(?= licensed)|expat license", "mit", ()),
    ("mit-0", "mit no attribution(?: license)?|mit 0(?: license)?", "mit", ()),
    ("bsd-2-clause", "(?:simplified|2 clause|two clause|freebsd) bsd(?: license)?|bsd 2 clause(?: license)?", "bsd", ()),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) bsd(?: license)?|bsd 3 clause(?: license)?", "bsd", ()),
    ("bsd-4-clause", "(?:original|4 clause) bsd(?: license)?|bsd 4 clause(?: license)?", "bsd", ()),
    ("bsd", "bsd(?: style)? license", "bsd", ()),
    ("0bsd", "0bsd(?: license)?|zero clause bsd(?: license)?", "bsd", ()),
    ("gpl", "(?:gnu )?general public license|gnu gpl|gpl", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license|gnu lgpl|lgpl", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "(?:gnu )?affero general public license|gnu agpl|agpl", "agpl", ("1.0", "3.0")),
    ("gfdl", "(?:gnu )?free documentation license|gnu fdl|gfdl", "documentation", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla public license|mpl", "mozilla", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public license|epl", "eclipse", ("1.0", "2.0")),
    ("edl", "eclipse distribution license", "eclipse", ("1.0",)),
    ("cpl", "common public license", "public", ("1.0",)),
    ("cddl", "common development and distribution license|cddl", "distribution", ("1.0", "1.1")),
    ("ipl", "ibm public license", "ibm", ("1.0",)),
    ("eupl", "european union public license|eupl", "eupl", ("1.0", "1.1", "1.2")),
    ("osl", "open software license", "software", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free license", "academic", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "(?:perl )?artistic license", "artistic", ("1.0", "2.0")),
    ("zlib", "zlib(?: libpng)? license", "zlib", ()),
    ("libpng", "(?:libpng|png reference library) license", "libpng", ("2.0",)),
    ("isc", "isc license", "isc", ()),
    ("boost", "boost software license|bsl(?= 1)", "boost", ("1.0",)),
    ("python", "python software foundation license|psf license", "python", ("2.0",)),
    ("ruby", "ruby license", "ruby", ()),
    ("php", "php license", "php", ("3.0", "3.01")),
    ("openssl", "openssl license", "openssl", ()),
    ("postgresql", "postgresql license", "postgresql", ()),
    ("unlicense", "unlicense(?: license)?|the unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl|do what the fuck you want to public license", "wtfpl", ("2.0",)),
    ("cc0", "cc0|creative commons zero|cc zero", "cc0", ("1.0",)),
    ("cc-by", "cc by|creative commons attribution", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:s|atives)", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-pdm", "public domain mark", "domain", ("1.0",)),
    ("public-domain", "(?:in|into|to) the public domain|public domain dedication", "domain", ()),
    ("odbl", "open (?:data commons open )?database license|odbl", "database", ("1.0",)),
    ("odc-by", "open data commons attribution license|odc by", "data", ("1.0",)),
    ("pddl", "(?:open data commons )?public domain dedication and license|pddl", "dedication", ("1.0",)),
    ("ofl", "sil open font license|open font license|ofl", "font", ("1.0", "1.1")),
    ("ms-pl", "microsoft public license|ms pl", "microsoft", ()),
    ("ms-rl", "microsoft reciprocal license|ms rl", "microsoft", ()),
    ("busl", "business source license|busl", "business", ("1.1",)),
    ("sspl", "server side public license|sspl", "server", ("1.0",)),
    ("elastic", "elastic license", "elastic", ("1.0", "2.0")),
    ("ncsa", "(?:university of illinois )?ncsa open source license", "ncsa", ()),
    ("upl", "universal permissive license", "universal", ("1.0",)),
    ("w3c", "w3c (?:software|document) (?:notice and )?license", "w3c", ()),
    ("x11", "x11 license|x consortium license", "x11", ()),
    ("proprietary", "proprietary(?: and confidential| license| software)", "proprietary", ()),
    ("reserved", "all rights reserved", "reserved", ()),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright", ()),
)
_NOTICE = "(?:(?:licensed|released|distributed|available|provided|published) under|subject to|covered by|governed by) (?:the )?(?:terms of (?:the )?)?"


_COMMON = ("license", "public", "open", "software")


def alternatives(name: str) -> list[str]:
    """The alternatives of a name, at its top level."""
    out, depth = [""], 0
    for c in name:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def held_words(alternative: str) -> list[str]:
    """The whole words that every match of an alternative holds."""
    plain = re.sub(r"\(\?=[^()]*\)|\(\?:[^()]*\)\?", "", alternative)
    plain = re.sub(r"(\(\?:)((?: [^()|]*\|?)+)\)", " ~", plain)  # choices that begin with a space
    plain = re.sub(r"\(\?:[^()]*\)|\w* \?", "~", plain)
    return [w for w in plain.split() if re.fullmatch("[0-9a-z]+", w)]


def gated(name: str, keyword: str) -> dict[str, str]:
    """The alternatives of a name by a word that they must hold: the given keyword, or else their longest word."""
    out: dict[str, list[str]] = {}
    for a in alternatives(name):
        held = held_words(a)
        gate = keyword if keyword in held else max(held, key=lambda w: (w not in _COMMON, len(w)))
        out.setdefault(gate, []).append(a)
    return {k: "|".join(v) for k, v in out.items()}


def rules() -> list[dict]:
    """The ordered rules: label, keyword (a word every match holds), regex on normalised words, priority."""
    spellings = [(label, name, gate, versions) for label, names, keyword, versions in FAMILIES for gate, name in gated(names, keyword).items()]
    out = []
    for label, name, keyword, versions in spellings:
        name = f"(?:{name})"
        for v in versions:
            major, _, minor = v.partition(".")
            digits = f"(?:version |v )?v?{major}" + (f"(?: {minor})?(?! [0-9]+ )" if minor == "0" else f" {minor}")
            full = f"{label}-{v}"
            spdx = " ".join(re.findall("[0-9a-z]+", full))
            out.append({"label": full, "keyword": "spdx", "regex": f" spdx license identifier {spdx}(?: only| or later)?(?= )", "priority": 5})
            out.append({"label": full, "keyword": keyword, "regex": f" {_NOTICE}{name} {digits}(?: (?:or later|license))?(?= )", "priority": 4})
            out.append({"label": full, "keyword": keyword, "regex": f" {name} {digits}(?= )", "priority": 3})
        if not versions:
            spdx = " ".join(re.findall("[0-9a-z]+", label))
            out.append({"label": label, "keyword": "spdx", "regex": f" spdx license identifier {spdx}(?= )", "priority": 5})
        out.append({"label": label, "keyword": keyword, "regex": f" {_NOTICE}{name}(?= )", "priority": 2})
        out.append({"label": label, "keyword": keyword, "regex": f" {name}(?= )", "priority": 1})
    out += [{"label": label, "keyword": gate, "regex": f" {regex}(?= )", "priority": p} for label, gate, regex, p in signatures()]
    for r in out:
        if r["keyword"] != "license":
            r["regex"] = re.sub(r"(?<= )license(?=[ ds)?|])", "licen[cs]e", r["regex"])
    return list({tuple(r.values()): r for r in out}.values())


def normalised(text: Column) -> Column:
    """The words of a text, each with a space before it, and a space at the end."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, the base counts and places, kept detections.

    ``detections`` holds (label, start, end, priority), word places from 0, end exclusive.
    """
    rule_list = rules()
    keywords = sorted({r["keyword"] for r in rule_list}, key=lambda k: (-len(k), k))
    df = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    df = df.withColumn("n_words", (F.expr(_spaces("t")) - 1).cast("long"))
    counts, firsts, lasts, labels = [], [], [], []
    for k, (phrase, label) in enumerate(BASE):
        width = len(phrase.split())
        df = df.withColumn(f"p{k}", F.when(F.col("t").contains(f" {phrase} "), F.split("t", f" {phrase}(?= )", -1)))
        counts.append(f"coalesce(size(p{k}) - 1, 0)")
        firsts.append(f"if(p{k} IS NULL, NULL, {_spaces(f'element_at(p{k}, 1)')})")
        lasts.append(f"if(p{k} IS NULL, NULL, n_words - {width} - ({_spaces(f'element_at(p{k}, -1)')} - 1))")
        labels.append(f"if(p{k} IS NULL, NULL, '{label}')")
    df = df.withColumn("found", F.array_distinct(F.regexp_extract_all("t", F.lit(f" ({'|'.join(keywords)})(?= )"), F.lit(1))))
    shape = "array<struct<label:string,keyword:string,regex:string,priority:int>>"
    df = df.withColumn("rules", F.when(F.size("found") > 0, F.filter(F.from_json(F.lit(json.dumps(rule_list)), shape), lambda r: F.array_contains("found", r["keyword"]))))
    # the places of a rule's matches: words before, summed over the parts between them
    matches = f"""
      flatten(transform(filter(rules, r -> t rlike r.regex), r ->
        aggregate(
          zip_with(slice(split(t, r.regex, -1), 1, size(split(t, r.regex, -1)) - 1), regexp_extract_all(t, r.regex, 0),
                   (part, hit) -> named_struct('before', {_spaces('part')}, 'words', {_spaces('hit')})),
          named_struct('at', 0, 'out', cast(array() as array<struct<label:string,start:int,end:int,priority:int>>)),
          (s, x) -> named_struct('at', s.at + x.before + x.words, 'out', concat(s.out, array(named_struct(
            'label', r.label, 'start', s.at + x.before, 'end', s.at + x.before + x.words, 'priority', r.priority)))),
          s -> s.out)))"""
    df = df.withColumn("all", F.when(F.size("rules") > 0, F.expr(matches)))
    ordered = """
      array_sort(all, (x, y) -> case when x.start <> y.start then x.start - y.start when x.end <> y.end then y.end - x.end
                                     when x.priority <> y.priority then y.priority - x.priority
                                     when x.label < y.label then -1 when x.label > y.label then 1 else 0 end)"""
    kept = f"""
      aggregate({ordered}, named_struct('reach', 0, 'out', cast(array() as array<struct<label:string,start:int,end:int,priority:int>>)),
        (s, x) -> if(x.end <= s.reach, s, named_struct('reach', x.end, 'out', concat(s.out, array(x)))), s -> s.out)"""
    df = df.withColumn("detections", F.coalesce(F.when(F.size("all") > 0, F.expr(kept)), F.expr("cast(array() as array<struct<label:string,start:int,end:int,priority:int>>)")))
    return df.select(
        "doc_id", "n_words", F.expr(" + ".join(counts)).cast("long").alias("n_base"),
        F.expr(f"cast(least({', '.join(firsts)}) as bigint)").alias("first_word"),
        F.expr(f"cast(greatest({', '.join(lasts)}) as bigint)").alias("last_word"),
        F.expr(f"array_sort(array_compact(array({', '.join(labels)})))").alias("base"), "detections",
    )


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    own = F.transform("detections", lambda d: d["label"])
    strength = F.array_max(F.transform("detections", lambda d: d["priority"])) / 5
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.greatest(F.coalesce(strength, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
