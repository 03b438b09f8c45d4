"""The digest of the whole corpus, by the batch and not in one value."""

import hashlib

from spanforge.sources import files


def test_fingerprint_is_that_of_the_concatenation(spark, monkeypatch):
    monkeypatch.setattr(files, "FINGERPRINT_BYTES", 10, raising=False)  # the bound that there was
    rows = [(k, None if k == 3 else f"text {k} é") for k in range(50)] + [(None, "no id")]
    got = files.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).first()
    whole = "".join(str(k) + (t or "") for k, t in sorted(rows[:-1], key=lambda r: str(r[0])))
    assert (got.fingerprint, got.n) == (hashlib.sha256(whole.encode()).hexdigest()[:16], 51)
