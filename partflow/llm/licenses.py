"""Licence scan: canonical digests of entire texts, joined with the digests of known licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published licence texts and notices, by their usual short names.
LICENSES = (
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
)
# Digests of the canonical form of licences too long to be quoted.
DIGESTS = (
    ("Apache-2.0", "e4b04d41863c0a48042a0ea49cf0928df0432290ae6cd85b4bca449ca8e892a4"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause-UC", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "b14f0b986c60d44e00f8499baa4a2c86731d53dc48c1da2a3769bfb63a083275"),
    ("GFDL-1.3", "f093d2ae192b9fe2d8ffc6d65fa94e420c7352831d9d258d2aaa8f68edee2ff7"),
    ("GPL-1.0", "3f1f6dbb5ee05700bcebfb3614340969a46f46e3403e82923c222005441cc60f"),
    ("GPL-2.0", "7e496b3a2195f357ecee57618e4769e7e4ec90e628d51131bcc7ee7823ad4c0c"),
    ("GPL-3.0", "9dfb92e0e8cef27a41d45a5d92081d7dc1f5d6d0f21e8adafa23d70dc75ff72a"),
    ("LGPL-2.0", "38f703b5ff0058211f2b7c92cd5c94e14eedcc04fadbd087fb1daa2956adbdab"),
    ("LGPL-2.1", "8fb23101df45b09cae74f15bd6e14fcec0eda2a699de023a6a7ab1705a300d41"),
    ("LGPL-3.0", "320153abe6f9c0241238200165d9b0f3d830d01a173b0dd6329ea9dee9cb4233"),
    ("MPL-1.1", "bf26bc7b8f356be58f343f35e09a018c962e01a0200f8049346a252d64b53f62"),
    ("MPL-2.0", "e28e8dae1fb9ff6116ca184589ed5ed5ea512c968fbcba1de4f74d8802d5098a"),
)
# Spellings that licence matching takes as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("labelled", "labeled"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("modelled", "modeled"), ("optimise", "optimize"),
    ("organisation", "organization"), ("recognise", "recognize"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
# Lines that are no part of a licence: statements of copyright (the word or sign with a year, another sign, "by" or a blank
# to fill in after it), reservations of rights, and titles, short lines that end in the word licence without saying that
# something is under it.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}©]*((copyright|©)[^\p{L}\p{N}]*(\(c\)|©|[0-9]{4}|by |<|\[)|\(c\)|all rights reserved[^\p{L}\p{N}]*$)"
TITLE_LINE, NO_TITLE = r"^[^\p{L}\p{N}]*([\p{L}\p{N}.+-]+ +){0,5}licen[cs]e *(\([^)]*\))?( *,? *version [0-9.]+)?[^\p{L}\p{N}]*$", r"(under|released|licen[cs]ed) "
APART = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright or title lines, words and numbers parted by one space, one spelling of each word."""
    kept = lambda line: ~line.rlike(COPYRIGHT_LINE) & ~(line.rlike(TITLE_LINE) & ~line.rlike(NO_TITLE))
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), kept)
    out = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, " "), APART, " "), F.lit(" "))
    for other, usual in SPELLINGS:
        for _ in range(2):  # neighbours share a space, so every second one is left by the first pass
            out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(out)


def known_licenses(spark) -> DataFrame:
    """(license, digest): a fixed list, the texts above and the digests of the long ones."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("body")) for name, text in LICENSES]))
    short = spark.range(1).select(rows.alias("row")).select("row.license", F.sha2(canonical(F.col("row.body")).cast("binary"), 256).alias("digest"))
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(digest).alias("digest")) for name, digest in DIGESTS]))
    return short.unionByName(spark.range(1).select(long.alias("row")).select("row.*"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, digest and license (null where the entire text is no known licence) of each row.

    A null or empty text has the digest of the empty text and no licence. Repeated rows and null ids are rows of their own; a
    text that the list has under two names has the first by name; columns to keep may have any name but digest and
    license; an empty table gives no rows. known: license, digest; without it the fixed list, which is broadcast; a list of
    one's own is joined as its size demands.
    """
    mine = docs.select(*keep, F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"))
    table = F.broadcast(known_licenses(docs.sparkSession)) if known is None else known
    table = table.groupBy("digest").agg(F.min("license").alias("license"))
    return mine.join(table, "digest", "left").select(*keep, "digest", "license")


def notices(spark, text: Column) -> Column:
    """The known licences that lines of a text name, each line taken as an entire text, by name and once each. Lines without
    the word licence are no notices; the fixed list goes along as a map."""
    known = sorted((r.digest, r.license) for r in known_licenses(spark).collect())  # the fixed list
    table = F.create_map(*[F.lit(x) for pair in known for x in pair])
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.lower(line).rlike("licen[cs]e"))
    names = F.transform(lines, lambda line: F.try_element_at(table, F.sha2(canonical(line).cast("binary"), 256)))
    return F.array_sort(F.array_distinct(F.array_compact(names)))


def canonical_sql(text: str) -> str:
    """The same form in DuckDB."""
    lines = (f"list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: NOT regexp_matches(l, '{COPYRIGHT_LINE}') "
             f"AND NOT (regexp_matches(l, '{TITLE_LINE}') AND NOT regexp_matches(l, '{NO_TITLE}')))")
    out = f"' ' || regexp_replace(array_to_string({lines}, ' '), '{APART}', ' ', 'g') || ' '"
    for other, usual in SPELLINGS:
        for _ in range(2):
            out = f"replace({out}, ' {other} ', ' {usual} ')"
    return f"trim({out})"


def scan_sql() -> str:
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in LICENSES)
    long = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    return f"""WITH known AS (SELECT license, sha256({canonical_sql("body")}) AS digest FROM (VALUES {known}) AS v(license, body) UNION ALL VALUES {long}),
    d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    mine AS (SELECT r, doc_id, sha256({canonical_sql("text")}) AS digest FROM d),
    lines AS (SELECT r, sha256({canonical_sql("line")}) AS digest FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d) WHERE regexp_matches(lower(line), 'licen[cs]e')),
    named AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known USING (digest) GROUP BY r)
    SELECT doc_id, mine.digest, license, coalesce(notices, '') AS notices FROM mine LEFT JOIN known ON mine.digest = known.digest LEFT JOIN named USING (r)"""
