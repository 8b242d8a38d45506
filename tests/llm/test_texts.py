"""Every operator reads bytes that are not UTF-8 as U+FFFD."""

import hashlib

import public_tokenizers
import pytest
from burstmill.llm import byte_bpe, licenses, near_copies, quotations, simhash, warc
from burstmill.llm.texts import decoded
from pyspark.sql import functions as F

RAW = "cast(concat(cast('Released under the MIT License.\\n' AS binary), X'FFC3', cast(' three four five' AS binary)) AS string)"


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    """Written and read again, as tables come."""
    path = str(tmp_path_factory.mktemp("texts") / "t")
    spark.range(2).selectExpr("id AS doc_id", f"{RAW} AS text", "'a' AS source", "'en' AS lang").write.parquet(path)
    return spark.read.parquet(path)


def test_helper():
    assert decoded(None) == decoded(b"") == "" and decoded(b"a\xffb") == "a�b"


def test_operators(spark, broken):
    text = "Released under the MIT License.\n�� three four five"
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.encode(broken, ranks, public_tokenizers.PATTERN, keep=["doc_id"], digests=True).select("encoding.*").collect()
    assert {r.decoded_sha256 for r in rows} == {hashlib.sha256(text.encode()).hexdigest()}
    assert {r.component_id for r in simhash.near_duplicates(broken.select("doc_id", "text")).collect()} == {0}
    assert near_copies.deduplicate(broken).count() == 1
    assert {r.own_license for r in licenses.scan(broken.withColumn("path", F.concat("source", F.lit("/"), "doc_id"))).collect()} == {"MIT"}
    talk = broken.selectExpr("0L AS conv_id", "cast(doc_id AS int) AS turn", "'user' AS role", "text")
    assert quotations.link(talk).count() == 2
    index = warc.write_archives(broken.selectExpr("doc_id AS page_id", "text AS url", "text AS html"))
    assert warc.read_records(index).count() == 2
