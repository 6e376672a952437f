import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwright.llm import license_scan


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.LicenceModel(spark)


def test_held_out_paragraphs(spark, model):
    """Wordings that training did not see, and text about licences."""
    known = [
        ("mit", "This library is released under the MIT License, see LICENSE."), ("apache", "The code is licensed under the Apache License, Version 2.0 (the License)."),
        ("gpl", "This tool is licensed under the GNU General Public License, version 2 or later."), ("cc-by-nc", "All figures are licensed under CC BY-NC 4.0."),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."), ("mpl", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ]
    unknown = ["My license expired in May.", "The public library has a general reading room.", "Copyright is taught in version two of the course.", "The gnu crossed the road.", "He was granted permission to enter."]
    out = license_scan.classified(license_scan._sentences(spark, [*known, *(("unknown", u) for u in unknown)]), model).collect()
    got = {r["paragraph"]: r["family"] for r in out}
    assert sum(got[p] == f for f, p in known) >= 5
    assert all(got[u] == "unknown" for u in unknown)


def test_scan(spark, docs, rows, empty, model):
    texts = [(i, f"{t or ''}\nReleased under the MIT License.\nmore" if i is not None and i % 7 == 0 else t) for i, t, *_ in rows]
    out = license_scan.scanned(spark.createDataFrame(texts, "doc_id long, text string").withColumn("family", F.lit("x")), model).collect()
    assert len(out) == len(rows)
    for r in out:
        mit = r["doc_id"] is not None and r["doc_id"] % 7 == 0
        assert (r["family"], r["families"], r["n_paragraphs"]) == (("mit", ["mit"], 1) if mit else (None, [], 0))
    assert license_scan.scanned(empty, model).count() == 0


def plain_grams(p):
    w = [m.group() for m in re.finditer(r"[^\W_]+(?:[.+'-][^\W_]+)*", p.lower())]
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return list(dict.fromkeys(w + pairs)), set(pairs)


def plain_class(p, model):
    """The softmax and the comparison from their definitions, without the gate."""
    known, pairs = plain_grams(p)
    place = {g: i for i, g in enumerate(model._vector.vocabulary)}
    x = np.zeros(len(place))
    for g in known:
        if g in place and not all(w in license_scan.COMMON for w in g.split(" ")):
            x[place[g]] = 1
    z = model._model.coefficientMatrix.toArray() @ x + model._model.interceptVector.toArray()
    prob = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family = model.families[int(prob.argmax())]
    like = max((len(t & pairs) / max(1, min(len(t), len(pairs))) for f, text in license_scan.notices() if f == family for t in [plain_grams(text)[1]]), default=0.0)
    sure = family != "unknown" and prob.max() >= model.threshold and like >= license_scan.SHARED
    return family if sure else "unknown", prob.max()


def test_brute_force(spark, rows, model):
    """Whole texts with notices, wrapped licences, repeated lines, a very long text and ties, against a plain classifier that sees every line and block."""
    grant = textwrap.fill(license_scan.TEMPLATES["mit"][5], 60)
    texts = [(i, t) for i, t, *_ in rows[:12]] + [
        (100, f"intro\n\n{grant}\n\noutro"), (101, "All rights reserved.\nAll rights reserved."), (102, "x y z " * 30000 + "\nLicensed under CC BY-NC 4.0."), (103, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."),
        (104, "My license expired.\nHe works at MIT on software.\nversion 2.0 of the game"), (105, None), (106, ""), (107, "// Licensed under the Apache License, Version 2.0\n// (the License); you may not use this file"),
    ]
    out = {r["doc_id"]: r for r in license_scan.scanned(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        t = t or ""
        blocks = [b.strip(" ") for b in re.split(r"\n\s*\n", t)]
        classes = lambda units: [c for c in (plain_class(u, model) for u in units if u.strip()) if c[0] != "unknown"]
        lines, joined = classes(re.split(r"\r?\n", t)), classes(re.sub(r"\s*\n\s*", " ", b) for b in blocks if "\n" in b)
        found = lines + joined
        assert out[i]["n_paragraphs"] == len(lines or joined), (i, found)
        assert out[i]["families"] == sorted({f for f, _ in found})
        if found:
            assert out[i]["family"] == max((round(p, 9), f) for f, p in found)[1] and abs(out[i]["probability"] - max(p for _, p in found)) < 1e-9
    assert out[100]["family"] == "mit" and out[101]["n_paragraphs"] == 2 and out[107]["family"] == "apache"
def test_the_gate_drops_nothing(spark, model):
    """Whatever the gate leaves out, the model itself calls unknown; every notice passes it."""
    assert model.gate
    rows = license_scan.notices() + [("", w) for p in license_scan.UNKNOWN + license_scan.CALIBRATION for w in (p, *p.split())]
    out = model.predicted(license_scan._sentences(spark, rows).where(~F.col("paragraph").rlike(model.gate))).collect()
    assert out and {r["family"] for r in out} == {"unknown"}
    assert license_scan._sentences(spark, license_scan.notices()).where(~F.col("paragraph").rlike(model.gate)).count() == 0
