"""Notices of fewer than five words, against brute force."""

import random
from collections import Counter

from tessera.llm import licenses


def test_short_notices(spark):
    rng, every = random.Random(3), licenses.TEMPLATES + licenses.SHORT_TEMPLATES
    texts = [None, "", "All rights reserved.", "rights reserved", "all rights", "SPDX-License-Identifier: MIT", "// spdx-license-identifier: Apache-2.0\nx"]
    for i in range(200):
        notice = rng.choice(licenses.SHORT_TEMPLATES)[1].split()
        if i % 4 == 0:
            notice[rng.randrange(len(notice))] = "other"
        longer = rng.choice(licenses.TEMPLATES)[1] if i % 5 == 0 else ""
        texts.append(" ".join([*rng.choices(["all", "rights", "mit", "a"], k=rng.randrange(40)), longer, *notice, *rng.choices(["reserved", "b"], k=rng.randrange(40))]))
    want = Counter()
    for i, text in enumerate(texts):
        tokens, found = licenses.words(text), set()
        for name, notice in every:
            k = min(licenses.SHINGLE, len(licenses.words(notice)))
            runs = [[tuple(x[j : j + k]) for j in range(len(x) - k + 1)] for x in (licenses.words(notice), tokens)]
            wanted = set(runs[0])
            span = -(-5 * len(wanted) // 4)
            if max((len(wanted & set(runs[1][j : j + span])) for j in range(len(runs[1]))), default=0) >= 0.8 * len(wanted):
                found.add(name)
        want[i, tuple(sorted(found))] += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.doc_id, tuple(r.licenses)) for r in licenses.scan_licenses(docs).collect())
    assert got == want and sum(bool(k[1]) for k in want) > 150
