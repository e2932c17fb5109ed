"""License scans against exact containment in all windows of a text."""

import random
import re

from tidewrack.llm import license_scan

SCHEMA = "doc_id long, text string, license string, n int"


def shingles(text):
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text):
    found, own = set(), shingles(text or "")
    for name, notice in license_scan.NOTICES:
        want = set(shingles(notice))
        width = 4
        while width <= len(want):
            width *= 4
        for start in range(-width, len(own), width):
            if len(want & set(own[max(0, start) : start + 2 * width])) >= 0.75 * len(want):
                found.add(name)
    return sorted(found)


def test_against_all_windows(spark):
    rng = random.Random(3)
    rows = []
    for d in range(120):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 4)):
            notice = rng.choice(license_scan.NOTICES)[1].split()
            if rng.random() < 0.5:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((d, " ".join(words), "x", 1))
    rows += [(200, None, None, None), (201, "", "x", 1), (None, license_scan.NOTICES[2][1].upper(), "x", 1), (3, rows[3][1], "x", 1)]
    got = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute(r[1]) for r in rows}
    for r in got:
        assert [x.license for x in r.licenses] == want[r.doc_id] and r.n_licenses == len(r.licenses)
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0
