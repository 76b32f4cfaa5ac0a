"""License scans by sentence rules, in DataFrame operations only.

A text is cut into units at line ends and after . ! ? ; when white space follows.  A unit is normalised: lower case, every
run of other characters than a-z 0-9 becomes one space.  Whole units, however many, are met with SENTENCES in one pattern
that takes an end of a unit for a space, so that a sentence wrapped over lines of any width is found too; of those that start
at a unit the longest counts, and the scan goes on behind it.  The identifiers found, in order, form a sequence in which RULES are matched: each rule is an ordered list of
identifiers, earlier rules consume what they match, and a match counts each time it occurs.

Everything happens inside a row: no shuffle, no explode before the result, nothing that a hot key could collect.  Texts
without any ANCHOR cannot hold a known sentence, which each contain one (a test checks that).

Cases: null or empty text gives no rows; repeated rows give their rows each; rules that tie are taken in the order of RULES;
only the id and text columns are read, so other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

#: Every known sentence holds one of these.
ANCHORS = ("licen", "copyright", "permission", "redistribution", "warrant", "unencumbered", "reserved")
#: (identifier, sentence).  Sentences of widely used licences and notices.
SENTENCES = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, 'Licensed under the Apache License, Version 2.0 (the "License");'),
    (3, "you may not use this file except in compliance with the License."),
    (4, "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (5, 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    (6, "See the License for the specific language governing permissions and limitations under the License."),
    (7, "SPDX-License-Identifier: Apache-2.0"),
    (8, "Released under the MIT License."),
    (9, "This project is licensed under the MIT License."),
    (10, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    (11, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (12, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    (13, "SPDX-License-Identifier: MIT"),
    (14, "This work is licensed under the GNU General Public License, version 3."),
    (15, "This work is licensed under the GNU General Public License, version 2."),
    (16, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (17, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    (18, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    (19, "You should have received a copy of the GNU General Public License along with this program."),
    (20, "SPDX-License-Identifier: GPL-3.0-or-later"),
    (21, "SPDX-License-Identifier: GPL-3.0-only"),
    (22, "SPDX-License-Identifier: GPL-2.0-only"),
    (23, "SPDX-License-Identifier: GPL-2.0-or-later"),
    (24, "Licensed under CC BY-NC 4.0."),
    (25, "Licensed under CC BY 4.0."),
    (26, "Licensed under CC BY-SA 4.0."),
    (27, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (28, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (29, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (30, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (31, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (32, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (33, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (34, "SPDX-License-Identifier: BSD-2-Clause"),
    (35, "SPDX-License-Identifier: BSD-3-Clause"),
    (36, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (37, "SPDX-License-Identifier: MPL-2.0"),
    (38, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (39, "SPDX-License-Identifier: ISC"),
    (40, "This is free and unencumbered software released into the public domain."),
    (41, "SPDX-License-Identifier: Unlicense"),
    (42, "This work is licensed under the GNU Lesser General Public License, version 3."),
    (43, "This work is licensed under the GNU Affero General Public License, version 3."),
    (44, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (45, "All rights reserved."),
    (46, "Licensed under the MIT License."),
    (47, "Licensed under the BSD 3-Clause License."),
    (48, "Released under the BSD 3-Clause License."),
    (49, "Licensed under CC BY-NC-SA 4.0."),
    (50, "Licensed under CC BY-ND 4.0."),
    (51, "Licensed under CC BY-NC-ND 4.0."),
    (52, "SPDX-License-Identifier: CC-BY-4.0"),
    (53, "SPDX-License-Identifier: CC0-1.0"),
]
#: (rule, licence, identifiers in order).  Longer rules first: they consume what they match.
RULES = [
    ("apache-2.0-header", "Apache-2.0", (2, 3, 4, 5, 6)),
    ("apache-2.0-header-short", "Apache-2.0", (2, 3)),
    ("apache-2.0-reference", "Apache-2.0", (1,)),
    ("apache-2.0-spdx", "Apache-2.0", (7,)),
    ("mit-text", "MIT", (10, 11, 12)),
    ("mit-grant", "MIT", (10,)),
    ("mit-released", "MIT", (8,)),
    ("mit-project", "MIT", (9,)),
    ("mit-licensed", "MIT", (46,)),
    ("mit-spdx", "MIT", (13,)),
    ("gpl-3.0-header", "GPL-3.0-or-later", (16, 18, 19)),
    ("gpl-2.0-header", "GPL-2.0-or-later", (17, 18, 19)),
    ("gpl-3.0-short", "GPL-3.0-or-later", (16,)),
    ("gpl-2.0-short", "GPL-2.0-or-later", (17,)),
    ("gpl-3.0-reference", "GPL-3.0-only", (14,)),
    ("gpl-2.0-reference", "GPL-2.0-only", (15,)),
    ("gpl-3.0-later-spdx", "GPL-3.0-or-later", (20,)),
    ("gpl-3.0-spdx", "GPL-3.0-only", (21,)),
    ("gpl-2.0-spdx", "GPL-2.0-only", (22,)),
    ("gpl-2.0-later-spdx", "GPL-2.0-or-later", (23,)),
    ("lgpl-3.0-reference", "LGPL-3.0-only", (42,)),
    ("agpl-3.0-reference", "AGPL-3.0-only", (43,)),
    ("cc-by-nc-4.0-short", "CC-BY-NC-4.0", (24,)),
    ("cc-by-4.0-short", "CC-BY-4.0", (25,)),
    ("cc-by-sa-4.0-short", "CC-BY-SA-4.0", (26,)),
    ("cc-by-4.0", "CC-BY-4.0", (27,)),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", (28,)),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", (29,)),
    ("cc-by-nc-sa-4.0-short", "CC-BY-NC-SA-4.0", (49,)),
    ("cc-by-nd-4.0-short", "CC-BY-ND-4.0", (50,)),
    ("cc-by-nc-nd-4.0-short", "CC-BY-NC-ND-4.0", (51,)),
    ("cc-by-4.0-spdx", "CC-BY-4.0", (52,)),
    ("cc0-1.0", "CC0-1.0", (44,)),
    ("cc0-1.0-spdx", "CC0-1.0", (53,)),
    ("bsd-3-text", "BSD-3-Clause", (30, 31, 32, 33)),
    ("bsd-2-text", "BSD-2-Clause", (30, 31, 32)),
    ("bsd-3-licensed", "BSD-3-Clause", (47,)),
    ("bsd-3-released", "BSD-3-Clause", (48,)),
    ("bsd-2-spdx", "BSD-2-Clause", (34,)),
    ("bsd-3-spdx", "BSD-3-Clause", (35,)),
    ("mpl-2.0-header", "MPL-2.0", (36,)),
    ("mpl-2.0-spdx", "MPL-2.0", (37,)),
    ("isc-text", "ISC", (38,)),
    ("isc-spdx", "ISC", (39,)),
    ("unlicense", "Unlicense", (40,)),
    ("unlicense-spdx", "Unlicense", (41,)),
    ("rights-reserved", "LicenseRef-proprietary", (45,)),
]


def known() -> dict[str, int]:
    """Normalised sentence -> identifier."""
    import re

    return {re.sub("[^a-z0-9]+", " ", text.lower()).strip(): i for i, text in SENTENCES}


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _anchored(text: str) -> str:
    """SQL: whether the text can hold a known sentence."""
    return "(" + " OR ".join(f"contains(lower({text}), '{a}')" for a in ANCHORS) + ")"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs and rule that matches: id, rule_id, license_id, n_matches, sentence_ids."""
    ids = "map(" + ", ".join(f"{_literal(s)}, {i}" for s, i in known().items()) + ")"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.expr(_anchored("_text")))
    rows = rows.selectExpr(
        "_id",
        r"""filter(transform(split(regexp_replace(_text, r'([.!?;])[\x20\x09-\x0D]+', '$1\n'), r'[\x0A\x0D]+'),
              u -> trim(regexp_replace(lower(u), '[^a-z0-9]+', ' '))), u -> u != '') AS _units""",
    )
    # at a unit's start the longest sentence first; a match ends with a unit, and the next begins behind it
    pattern = "(?m)^(?:" + "|".join(x.replace(" ", r"[ \n]") for x in sorted(known(), key=len, reverse=True)) + ")$"
    # no filter on these columns: it would be pushed below them and their expressions repeated
    rows = rows.withColumn("_known", F.expr(ids))
    rows = rows.withColumn("_found", F.expr(rf"""array_join(transform(regexp_extract_all(array_join(_units, '\n'), '{pattern}', 0), x -> concat('<', _known[replace(x, '\n', ' ')], '>')), '')"""))
    rules = ", ".join(f"named_struct('rule_id', '{rule}', 'license_id', '{licence}', 'p', '{''.join(f'<{i}>' for i in ids_)}')" for rule, licence, ids_ in RULES)
    matched = F.expr(f"""aggregate(array({rules}), named_struct('s', _found, 'out', cast(array() AS array<struct<rule_id: string, license_id: string, n_matches: bigint>>)),
        (a, r) -> CASE WHEN NOT contains(a.s, r.p) THEN a ELSE named_struct('s', replace(a.s, r.p, '|'), 'out', concat(a.out, array(named_struct(
            'rule_id', r.rule_id, 'license_id', r.license_id, 'n_matches', (length(a.s) - length(replace(a.s, r.p, '|'))) div (length(r.p) - 1))))) END).out""")
    rows = rows.select("_id", "_found", F.explode_outer(matched).alias("_m")).where("_m IS NOT NULL")
    listed = F.expr("replace(replace(replace(_found, '><', ','), '<', ''), '>', '')")
    return rows.select(F.col("_id").alias(id_col), "_m.rule_id", "_m.license_id", "_m.n_matches", listed.alias("sentence_ids"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    span = max(len(s.split()) for s in known())  # a sentence has no more units than words
    values = ", ".join(f"({_literal(s)}, {i})" for s, i in known().items())
    rules = ", ".join(f"({k}, '{rule}', '{licence}', '{''.join(f'<{i}>' for i in ids)}')" for k, (rule, licence, ids) in enumerate(RULES))
    return rf"""
WITH RECURSIVE known(s, id) AS (VALUES {values}), rules(k, rule_id, license_id, p) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[\x0A\x0D]+'),
        lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS units FROM documents WHERE {_anchored('text')}),
starts AS (SELECT r, doc_id, units, unnest(range(0, len(units))) AS i FROM u),
hits AS (SELECT r, doc_id, i, max_by(id, n) AS id, max(n) AS n FROM (
  SELECT r, doc_id, i, k.n, array_to_string(units[i + 1:i + k.n], ' ') AS s FROM starts, (SELECT unnest(range(1, {span + 1})) AS n) k WHERE i + k.n <= len(units)) JOIN known USING (s) GROUP BY ALL),
walk AS (SELECT r, doc_id, i, i + n AS nxt, id FROM hits h WHERE i = (SELECT min(i) FROM hits g WHERE g.r = h.r)
  UNION ALL SELECT h.r, h.doc_id, h.i, h.i + h.n, h.id FROM walk w JOIN hits h ON h.r = w.r AND h.i = (SELECT min(i) FROM hits g WHERE g.r = w.r AND g.i >= w.nxt)),
found AS (SELECT r, doc_id, string_agg('<' || id || '>', '' ORDER BY i) AS f, string_agg(id, ',' ORDER BY i) AS sentence_ids FROM walk GROUP BY ALL),
fold AS (SELECT r, doc_id, sentence_ids, f, cast(-1 AS BIGINT) AS k, 0 AS n FROM found
  UNION ALL SELECT r, doc_id, sentence_ids, replace(f, p, '|'), fold.k + 1, (length(f) - length(replace(f, p, '|'))) // (length(p) - 1) FROM fold JOIN rules ON rules.k = fold.k + 1)
SELECT doc_id, rule_id, license_id, cast(n AS BIGINT) AS n_matches, sentence_ids FROM fold JOIN rules USING (k) WHERE n > 0
"""


SQL = _sql()
