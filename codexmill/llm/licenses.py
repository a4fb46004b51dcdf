"""License scans: TF-IDF cosine of licence notices to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
from collections import Counter
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices and SPDX names (fixed values).
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_TITLE = "GNU {} Version {}, {} Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Header blocks, titles and paragraphs of full texts (fixed values).
HEADERS = (
    ("AGPL-3.0", _GPL.format("Affero General Public License", 3)),
    ("AGPL-3.0", _GPL_TITLE.format("AFFERO GENERAL PUBLIC LICENSE", 3, "19 November 2007", "2007")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD + _BSD_1),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD + _BSD_1 + _BSD_3),
    ("BSD-3-Clause", _BSD_3),
    ("GPL-2.0", _GPL.format("General Public License", 2)),
    ("GPL-2.0", _GPL_TITLE.format("GENERAL PUBLIC LICENSE", 2, "June 1991", "1989, 1991")),
    ("GPL-3.0", _GPL.format("General Public License", 3)),
    ("GPL-3.0", _GPL_TITLE.format("GENERAL PUBLIC LICENSE", 3, "29 June 2007", "2007")),
    ("LGPL-2.1", _GPL.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", 3)),
    ("LGPL-3.0", _GPL_TITLE.format("LESSER GENERAL PUBLIC LICENSE", 3, "29 June 2007", "2007")),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: A declared identifier or expression; what follows says which versions it takes.
_SPDX = r"(?i)spdx-license-identifier:\s*\(?\s*([a-z0-9.+-]+(?:\s+(?:or|and|with)\s+[a-z0-9.+-]+)*)"
_SUFFIX = r"(?i)(-only|-or-later|\+)(?![a-z0-9.-])"
_COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--+)[ \t]*|[ \t]*(?:\*+/|--+>)[ \t]*\r?$"
#: Year and holder between the two halves of a reservation.
_HOLDER = r"(?i)copyright\s*(?:\(c\)|©)?\s*[0-9]{4}.*?all rights reserved"
#: Lines without any of these are no notices.
CUES = r"licen[sc]e|copyright|public domain|redistribution|permission is hereby|spdx|rights reserved"
MIN_COSINE = 0.8
_TERM = r"[a-z0-9]+"


def _template_rows() -> list[tuple[int, str, str, float]]:
    """(number, name, term, unit-length weight): terms weigh (count) * (ln((1 + n) / (1 + templates with it)) + 1); headers have the weights of the templates."""
    counts = [Counter(re.findall(_TERM, text.lower())) for _, text in TEMPLATES + HEADERS]
    idf = _idf()
    rows = []
    for n, ((name, _), c) in enumerate(zip(TEMPLATES + HEADERS, counts)):
        w = {t: k * idf.get(t, _unseen()) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(n, name, t, x / norm) for t, x in sorted(w.items())]
    return rows


def _idf() -> dict[str, float]:
    seen = Counter(t for _, text in TEMPLATES for t in set(re.findall(_TERM, text.lower())))
    return {t: math.log((1 + len(TEMPLATES)) / (1 + k)) + 1 for t, k in seen.items()}


def _unseen() -> float:
    return math.log(1 + len(TEMPLATES)) + 1


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def notices(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(path, line, license, cosine, whole) of all notices of all texts that are like a template or header: lines, and blocks
    of two lines or more that blank lines part, without comment marks, joined. A declared SPDX identifier is its own notice.

    whole: the notice is all the text has, as in a licence file. A notice that is as like another licence is none, nor is
    one of a family with several versions that does not say which. Templates are a fixed list, so their terms are broadcast."""
    spark = files.sparkSession
    unseen = _unseen()
    idf = spark.createDataFrame(sorted(_idf().items()), "term string, idf double")
    known = spark.createDataFrame(_template_rows(), "template int, name string, term string, weight double")
    names = sorted({name for name, _ in TEMPLATES + HEADERS} - {"Proprietary"})
    bare = F.trim(F.regexp_replace("text", r"\s+", " ")).isin(names)
    texts = files.where(F.lower("text").rlike(CUES) | bare).select("path", "text", bare.alias("bare"), F.split("text", "\n").alias("lines"))
    texts = texts.withColumn("filled", F.size(F.filter("lines", lambda x: F.trim(x) != "")))
    single = texts.select("path", "filled", F.posexplode("lines").alias("line", "value"), F.lit(1).alias("size"), "bare").where(F.lower("value").rlike(CUES) | (F.col("bare") & (F.trim("value") != "")))
    plain = texts.select("path", "filled", F.regexp_replace("text", _COMMENT, "").alias("plain"))
    blocks = plain.select("path", "filled", "plain", F.explode(F.split("plain", r"\n(?:[ \t\r]*\n)+")).alias("block")).where(F.lower("block").rlike(CUES))
    blocks = blocks.withColumn("size", F.size(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != ""))).where("size > 1")
    before = F.expr("left(plain, locate(block, plain) - 1)")
    blocks = blocks.select("path", "filled", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).alias("line"), F.translate("block", "\n", " ").alias("value"), "size", F.lit(False).alias("bare"))
    lines = single.unionByName(blocks)
    lines = lines.withColumn("value", F.regexp_replace("value", _HOLDER, "Copyright. All rights reserved"))
    declared = F.regexp_replace(F.upper(F.regexp_replace(F.regexp_extract("value", _SPDX, 1), _SUFFIX, "")), r"\s+", " ")
    spelled = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n.upper(), n)]), declared), F.regexp_replace(F.regexp_extract("value", _SPDX, 1), _SUFFIX, ""))
    said = lines.where("size = 1").select("path", "filled", "line", "size", F.when(F.col("bare") & F.trim("value").isin(names), F.trim("value")).otherwise(spelled).alias("license")).where("license <> ''")
    # equal notices are weighed once, however many documents have them, and under their digest: a block may be a whole text
    lines = lines.withColumn("key", F.sha2("value", 256))
    distinct = lines.select("key", "value").distinct()
    terms = distinct.select("key", F.explode(F.regexp_extract_all(_ascii_lower(F.col("value")), F.lit(_TERM), F.lit(0))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("n"))
    weighed = terms.join(F.broadcast(idf), "term", "left").select("key", "term", (F.col("n") * F.coalesce("idf", F.lit(unseen))).alias("w"))
    dots = weighed.join(F.broadcast(known), "term").groupBy("key", "template", "name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = dots.join(norms, "key").select("key", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= min_cosine)
    best = scored.groupBy("key", "name").agg(F.max("cosine").alias("cosine")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cosine", "name")), asc=False).alias("b"))
    best = best.where((F.size("b") == 1) | (F.get("b", F.lit(0))["cosine"] > F.get("b", F.lit(1))["cosine"]))
    best = best.select("key", F.col("b")[0]["name"].alias("license"), F.col("b")[0]["cosine"].alias("cosine"))
    # of a family with several versions in the list, the notice must say its version
    version = F.regexp_extract("license", r"^L?GPL-([0-9]+)", 1)
    stated = (version == "") | F.rlike(F.col("value"), F.concat(F.lit("(?<![0-9.])"), version, F.lit("(?![0-9])")))
    found = lines.join(best, "key").where(stated).select("path", "line", "license", "cosine", "filled", "size")
    found = found.unionByName(said.select("path", "line", "license", F.lit(1.0).alias("cosine"), "filled", "size"))
    return found.select("path", "line", "license", "cosine", (F.col("filled") == F.col("size")).alias("whole"))


def _above(path: Column) -> Column:
    """All directories above a path, nearest first; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def license_scan(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(path, own_license, own_cosine, license, license_from) for every row of files(path, text, is_license_file).

    own_license: the notice with the highest cosine in the text (the first line among equals). A text without one takes
    the licence of the nearest directory above that has a licence file with a notice (the file with the least path where
    there are several); license_from is that directory, null where none has. Null texts have no notice; rows with a null
    path have no directory; repeated rows get a result each; extra columns are ignored; an empty table gives an empty result."""
    found = notices(files.select("path", F.coalesce("text", F.lit("")).alias("text")), min_cosine)
    own = found.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("line").alias("l"), F.col("license").alias("n"))).alias("b"))
    own = own.select(F.col("path").alias("__path"), F.col("b.n").alias("own_license"), (-F.col("b.c")).alias("own_cosine"))
    marked = files.select("path", "is_license_file").join(own, F.col("path") == F.col("__path"), "left").drop("__path")
    directory = F.element_at(_above(F.col("path")), 1)
    named = marked.where("is_license_file and own_license is not null").groupBy(directory.alias("directory")).agg(F.min_by("own_license", "path").alias("inherited"))
    bare = marked.where("own_license is null and path is not null").select("path").distinct()
    up = bare.select("path", F.posexplode(_above(F.col("path"))).alias("steps", "directory"))
    nearest = up.join(named, "directory").groupBy("path").agg(F.min(F.struct("steps", "directory", "inherited")).alias("b"))
    nearest = nearest.select(F.col("path").alias("__path"), F.col("b.inherited").alias("inherited"), F.col("b.directory").alias("license_from"))
    return marked.join(nearest, F.col("path") == F.col("__path"), "left").select(
        "path", "own_license", F.round("own_cosine", 4).alias("own_cosine"), F.coalesce("own_license", "inherited").alias("license"), "license_from"
    )


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files: path source/lang/doc_id; one whose first or last line is a notice stands for its directory's licence file."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")))
    edge = F.lower(F.concat_ws(" ", F.element_at(F.split("text", "\n"), 1), F.element_at(F.split("text", "\n"), -1)))
    return docs.select(
        "doc_id", F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"), "text", F.coalesce(edge.rlike(CUES), F.lit(False)).alias("is_license_file")
    )
