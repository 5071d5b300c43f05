"""Operator 10 on documents that are the full text of a licence."""

from importlib import resources

from ratewright.llm import licenses


def test_full_texts_are_known(spark):
    folder = resources.files("ratewright.llm").joinpath("license_texts")
    texts = {f.name.removesuffix(".txt").removesuffix(".regents"): f.read_text() for f in folder.iterdir()}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    docs = [(i, "\n" + t.upper().replace("LICENSE", "LICENCE") + " ", i) for i, t in sorted(texts.items())]
    docs += [("headed", "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + texts["BSD-3-Clause"], "BSD-3-Clause")]
    docs += [("bare", texts["Apache-2.0"].split("APPENDIX: How to apply")[0], "Apache-2.0"), ("longer", texts["MPL-2.0"] + " and more", None)]
    df = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(docs)], "doc_id long, text string")
    got = {docs[r.doc_id][0]: r.license_id for r in licenses.scan_licenses(df, licenses.known_licenses(spark)).collect()}
    assert got == {i: want for i, _, want in docs}
