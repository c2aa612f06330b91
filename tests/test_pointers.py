"""Evidence pointers against every commit and file."""
import random

import pytest

from turnwise.operators import findings


@pytest.mark.parametrize("seed", range(2))
def test_pointers_with_many_digests_that_begin_alike(spark, seed):
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("01ab") for _ in range(n))
    shas = ["aaaaaaa" + digits(33) for _ in range(300)] + [digits(40) for _ in range(100)] + ["abc", "abcd"]
    paths = ["a.txt", "aaaaaaab"]
    refs = [rng.choice(shas)[:rng.randint(5, 40)] for _ in range(300)] + ["aaaaaaa" + digits(rng.randint(0, 8)) for _ in range(200)]
    refs += [digits(7) + "z", "a.txt", "aaaaaaab", "abc", "abcd", "ab", "", "aaaaaaa~", "é" * 8, None, shas[0], shas[0] + "0"]
    claims = list(enumerate(refs))
    got = findings.evidence_resolves(spark.createDataFrame(claims, "claim int, ref string"), spark.createDataFrame([(s,) for s in shas + shas[:9] + [None]], "sha string"),
                                     spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    want = {(c, r) for c, r in claims if r is None or r not in paths and r not in shas and not (len(r) >= 7 and any(s.startswith(r) for s in shas))}
    assert {(r.claim, r.ref) for r in got} == want and len(got) == len(want)
