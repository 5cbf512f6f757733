"""License scans by canonical digest: entire texts and whole lines, hash-joined to digests of known licences.

A canonical text is in lower case, without copyright lines, with one spelling of words that licences spell in several
ways, and without punctuation. Its SHA-256 is compared, so a match means that the entire text (or the entire line, for
notices) is the licence but for those differences. DataFrame functions only.

Known are the whole texts and notices in KNOWN, with and without title lines, and longer licences by their digests; a table
of more can be given. Defined cases: null and blank texts have the digest of the empty string and match nothing; texts of
any length are reduced whole; rows of one id share the notices found under it; rows with a null id have no notices; an empty
table gives an empty one; columns other than id and text are ignored, whatever their names. Ties (two names for a digest)
go to the least name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import broadcast_if_small, materialise

#: Texts and notices of known licences; any table (license_id, text) can take their place.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
)
#: Title lines that files of these licences begin with.
TITLES = (("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"))
#: Digests of the canonical texts of longer licences, as published.
DIGESTS = (
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5a3b24c0d356ef8989faaaabae94f88aae352636c3cd36da5f5a76f39cd16b83"),
    ("GFDL-1.3", "9330d425b8d1073fd89f543fb54e3a4b4c91abbbcd9a5b933b57f3edc95832bd"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7"),
    ("GPL-3.0", "969fd5d620157eced8b632e4ba7154859f195397976b89e7ee716615116fc70a"),
    ("LGPL-2.0", "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614"),
    ("LGPL-2.1", "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

#: Spellings that count as the same word (the left one, a pattern, is replaced by the right one).
SPELLINGS = (
    ("licen[cs]e", "license"),
    ("sub[- ]licens", "sublicens"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("non-infringement", "noninfringement"),
)
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:(?:copyright(?: \(c\)| ©)? [0-9]|\(c\) [0-9]|©)[^\n]*|all rights reserved\.?[ \t\r]*)$"


def canonical(text: Column) -> Column:
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for pattern, word in SPELLINGS:
        c = F.regexp_replace(c, pattern, word)
    return F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_texts() -> list[tuple[str, str]]:
    """KNOWN, and its whole texts under their title lines."""
    return [*KNOWN, *((name, f"{title}\n\n{text}") for name, title in TITLES for own, text in KNOWN if own == name and len(text) > 300)]


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id), one row per digest, of a table (license_id, text) or (license_id, digest)."""
    own = F.col("digest") if "digest" in known.columns else digest(F.col("text"))
    return known.select(own.alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, max_broadcast: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (of the entire text, else null), n_notices and notices (licences named by whole lines)."""
    spark = docs.sparkSession
    if known is None:
        texts = known_digests(spark.createDataFrame(known_texts(), "license_id string, text string"))
        known = texts.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))
    names = broadcast_if_small(materialise(known_digests(known), "licences"), max_broadcast)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = texts.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", digest(F.col("line")).alias("digest"))
    notices = lines.join(names, "digest").groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = texts.select("doc_id", digest(F.col("text")).alias("digest")).join(names, "digest", "left")
    return whole.join(notices, "doc_id", "left").select("doc_id", "digest", "license_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql() -> str:
    def canon(c: str) -> str:
        c = f"regexp_replace(lower({c}), '{COPYRIGHT_LINE}', '', 'g')"
        for pattern, word in SPELLINGS:
            c = f"regexp_replace({c}, '{pattern}', '{word}', 'g')"
        return f"trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_texts())
    longer = ", ".join(f"('{a}', '{b}')" for a, b in DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(l) AS license_id FROM (SELECT l, sha256({canon('t')}) AS digest FROM (VALUES {rows}) AS k(l, t) UNION ALL SELECT l, d FROM (VALUES {longer}) AS k(l, d)) GROUP BY 1),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, sha256({canon('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts WHERE doc_id IS NOT NULL)),
notices AS (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT t.doc_id, t.digest, k.license_id, coalesce(n.n_notices, 0)::BIGINT AS n_notices, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, sha256({canon('text')}) AS digest FROM texts) t LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)
"""
