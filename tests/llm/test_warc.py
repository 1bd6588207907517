"""The registered query reads headers: a wrong one stops it."""
import pytest
from pyspark.sql import functions as F

from txrisk.llm import warc
from txrisk.llm.queries import QUERIES


def test_headers_tell_what_the_tables_do(spark, awkward):
    told = QUERIES["op8_warc"](spark, awkward).collect()
    assert {r.record_type for r in told} == {"response", "revisit"}


def test_a_null_id_has_no_line(spark):
    heads = spark.createDataFrame([(None,), (3,)], "page_id long").select("page_id", warc._uri(F.col("page_id")).alias("uri")).collect()
    assert [r.uri is None for r in heads] == [True, False]


@pytest.mark.parametrize("old, new", [("WARC-Type: response", "WARC-Type: revisit"), ("WARC-Type: revisit", "WARC-Type: response"),
                                      ("WARC-Refers-To: <urn:uuid:.", "WARC-Refers-To: <urn:uuid:!"), ("sha1:.", "sha1:!"),
                                      ("WARC-Record-ID: <urn:uuid:.", "WARC-Record-ID: <urn:uuid:!"), ("Content-Length: ", "Content-Length: 1"),
                                      ("\r\n\r\n$", "\r\n"), ("WARC/1.1", "WARC/0.9")])
def test_a_wrong_header_is_an_error(spark, awkward, monkeypatch, old, new):
    whole = warc._header
    monkeypatch.setattr(warc, "_header", lambda r: F.regexp_replace(whole(r).cast("string"), old, new).cast("binary"))
    with pytest.raises(Exception, match="header differs"):
        QUERIES["op8_warc"](spark, awkward).collect()
