"""Licence scan by sentence rules, with DataFrame and SQL functions only.

A text is normalised (A-Z lower-cased, all but letters and digits to single spaces) and cut into sentences; those that
equal a known licence sentence become its identifier. The document's sequence of identifiers is then matched against
ordered rules: the first rule replaces each of its sequences by a licence, the next one works on what is left, and so
on, so that a longer licence wins over a shorter one that it contains. Texts are read twice over: once with each line
end as a sentence end, and once with wrapped lines joined; licences found either way count.

Everything happens within the row, without a shuffle. Defined results: a null, empty or blank text has no sentences;
rows are independent, so repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

# Licences by SPDX identifier, the names that texts give them, and their class.
LICENSES = {
    "Apache-2.0": ("permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0"]),
    "MIT": ("permissive", ["MIT License", "MIT"]),
    "ISC": ("permissive", ["ISC License", "ISC"]),
    "BSD-2-Clause": ("permissive", ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"]),
    "BSD-3-Clause": ("permissive", ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"]),
    "Zlib": ("permissive", ["zlib License", "Zlib"]),
    "BSL-1.0": ("permissive", ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"]),
    "Unlicense": ("permissive", ["Unlicense"]),
    "CC0-1.0": ("permissive", ["CC0 1.0", "CC0-1.0", "Creative Commons Zero 1.0", "CC0"]),
    "CC-BY-4.0": ("permissive", ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"]),
    "CC-BY-SA-4.0": ("copyleft", ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    "CC-BY-SA-3.0": ("copyleft", ["CC BY-SA 3.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0 License"]),
    "CC-BY-NC-4.0": ("noncommercial", ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    "CC-BY-NC-SA-4.0": ("noncommercial", ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"]),
    "CC-BY-NC-ND-4.0": ("noncommercial", ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"]),
    "CC-BY-ND-4.0": ("noderivatives", ["CC BY-ND 4.0", "CC-BY-ND-4.0"]),
    "GPL-2.0": ("copyleft", ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"]),
    "GPL-3.0": ("copyleft", ["GNU General Public License, version 3", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"]),
    "LGPL-2.1": ("copyleft", ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"]),
    "LGPL-3.0": ("copyleft", ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"]),
    "AGPL-3.0": ("copyleft", ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"]),
    "MPL-2.0": ("copyleft", ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"]),
    "EPL-2.0": ("copyleft", ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"]),
}
CLASSES = ["proprietary", "noncommercial", "noderivatives", "copyleft", "permissive"]  # the strictest first
GRANTS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under {}", "Distributed under the {}",
          "Available under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}",
          "This software is licensed under the {}", "This project is licensed under the {}", "This file is licensed under the {}",
          "This program is licensed under the {}", "This code is licensed under the {}", "This document is licensed under the {}",
          "SPDX-License-Identifier: {}", "License: {}", "Use of this source code is governed by the {}"]
# Sentences of licence texts and notices.
SENTENCES = {
    "reserved": ["All rights reserved", "All rights are reserved"],
    "confidential": ["Proprietary and confidential", "Confidential and proprietary",
                     "Unauthorized copying of this file, via any medium is strictly prohibited"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                  "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                  "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
                  "the following conditions"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as_is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
              "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
                  "above copyright notice and this permission notice appear in all copies"],
    "bsd_intro": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                   "documentation and/or other materials provided with the distribution"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                    "software without specific prior written permission"],
    "apache_comply": ["you may not use this file except in compliance with the License",
                      "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2_free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "mpl_notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
# Ordered rules: a sequence of sentence identifiers (?: may be missing) and what it stands for.
RULES = [
    (["mit_grant", "mit_notice", "as_is?"], "MIT"),
    (["mit_grant", "as_is?"], "MIT"),
    (["isc_grant", "as_is?"], "ISC"),
    (["bsd_intro", "bsd_source", "bsd_binary", "bsd_endorse"], "BSD-3-Clause"),
    (["bsd_intro", "bsd_source", "bsd_binary"], "BSD-2-Clause"),
    (["grant:Apache-2.0", "apache_comply"], "Apache-2.0"),
    (["apache_comply"], "Apache-2.0"),
    (["gpl_free"], "GPL-3.0-or-later"),
    (["gpl2_free"], "GPL-2.0-or-later"),
    (["mpl_notice"], "MPL-2.0"),
    (["unlicense"], "Unlicense"),
    *[([f"later:{k}"], f"{k}-or-later") for k in LICENSES if "GPL" in k],
    *[([f"grant:{k}"], k) for k in LICENSES],
    (["confidential", "reserved?"], "Proprietary"),
    (["reserved", "confidential?"], "All-Rights-Reserved"),
]


def plain(sentence: str) -> str:
    """A sentence as texts are normalised."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier, from the lists above; its size is that of the lists, whatever the input."""
    out = {plain(s): k for k, ss in SENTENCES.items() for s in ss}
    for k, (_, names) in LICENSES.items():
        for g in GRANTS:
            for n in names:
                for end in ("", " license") if "license" not in n.lower() else ("",):
                    out[plain(g.format(n) + end)] = f"grant:{k}"
                    if "GPL" in k:
                        for more in (" or later", ", or (at your option) any later version", "+", "-or-later"):
                            if more != "+":
                                out[plain(g.format(n) + end + more)] = f"later:{k}"
    return out


def sentences(text: Column, by_line: bool) -> Column:
    """Normalised sentences of a text, in order. A full stop inside a number or a name ends none, a colon only ends a line's last."""
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, "[.!?]+(?=\\s|$)|:+(?=\\s*(?:\\n|$))" + ("|\\n" if by_line else "|\\n[^a-z0-9]*\\n"), "\x01")
    return F.split(F.regexp_replace(t, "[^a-z0-9\x01]+", " "), " ?\x01[\x01 ]*")


def identified(text: Column, by_line: bool) -> Column:
    """The text's known sentences as identifiers, in order."""
    known = known_sentences()
    name = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    found = F.filter(F.transform(sentences(text, by_line), lambda s: F.btrim(s)), lambda s: s.isin(*known))
    return F.transform(found, lambda s: F.element_at(name, s))


def recognised(ids: Column) -> Column:
    """Licences of a sequence of identifiers, in the order of the text."""
    seq = F.concat(F.lit(";"), F.array_join(ids, ";;"), F.lit(";"))
    for parts, licence in RULES:
        pattern = "".join(f"(?:;{re.escape(p[:-1])};)?" if p[-1] == "?" else f";{re.escape(p)};" for p in parts)
        seq = F.regexp_replace(seq, pattern, f"<{licence}>")
    return F.regexp_extract_all(seq, F.lit("<([^>]*)>"), F.lit(1))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses, license_class (null without a licence) per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", identified(text, True).alias("lines"), identified(text, False).alias("joined"))
    none = F.array().cast("array<string>")
    # The rules' chain runs only where a sentence is known.
    d = d.withColumn("licenses", F.when(F.size("lines") + F.size("joined") > 0, F.array_distinct(F.concat(recognised(F.col("joined")), recognised(F.col("lines"))))).otherwise(none))
    kind = F.lit(None).cast("string")
    for c in reversed(CLASSES):
        of = ["Proprietary", "All-Rights-Reserved"] if c == "proprietary" else [x for k, (kc, _) in LICENSES.items() if kc == c for x in (k, f"{k}-or-later")]
        kind = F.when(F.arrays_overlap("licenses", F.array(*[F.lit(x) for x in of])), c).otherwise(kind)
    return d.select("doc_id", F.when(F.size("joined") >= F.size("lines"), F.col("joined")).otherwise(F.col("lines")).alias("sentence_ids"), "licenses", kind.alias("license_class"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: known licence sentences and licences of every document."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                      F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), "license_class")
