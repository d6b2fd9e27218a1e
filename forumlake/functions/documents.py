"""JSON documents kept as text, their fields, hashes and ciphers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the document format.
SCHEMA_VERSION = "4"
DOCUMENT_SOURCE = "reddit"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field(document, key: str) -> Column:
    """A field as text; JSON null and a missing field are both NULL."""
    return F.get_json_object(_col(document), f"$.{key}")


def fields(df: DataFrame, document: str, *keys: str) -> DataFrame:
    """Add several fields as columns with one parse of the document."""
    return df.select("*", F.json_tuple(_col(document), *keys).alias(*keys))


def to_document(*columns: Column) -> Column:
    """JSON text that keeps NULL fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def analysis_document(category, reference_id, llm, analysis) -> Column:
    return to_document(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(DOCUMENT_SOURCE).alias("source"),
        _col(category).alias("category"),
        _col(reference_id).alias("reference_id"),
        _col(llm).alias("llm"),
        _col(analysis).alias("analysis"),
    )


# Strict JSON, whatever the session says.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE",
          "columnNameOfCorruptRecord": "_bad"}


def is_json(text) -> Column:
    """Whether the whole text is one JSON value; null is not. Repeated keys of an object are valid.

    The parser stops behind a value, so the text is tried as the only element of an array
    and as a field: what trails a value breaks one of them.
    """
    line = _col(text)
    element = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>", STRICT)
    field = F.from_json(F.concat(F.lit('{"v":'), line, F.lit("}")), "v string, _bad string", STRICT)
    return F.coalesce((F.size(element) == 1) & field["_bad"].isNull(), F.lit(False))


def parsed_documents(documents, schema: str) -> Column:
    """An array of JSON texts as an array of structs."""
    return F.transform(_col(documents), lambda d: F.from_json(d, schema))


def sha512_hex(text) -> Column:
    return F.sha2(_col(text), 512)


def sha256_hex(text) -> Column:
    return F.sha2(_col(text), 256)


def encrypt_text(text, key) -> Column:
    """AES-GCM, base64 text. ``key`` is a column or a literal of 16, 24 or 32 bytes."""
    k = key if isinstance(key, Column) else F.lit(key)
    return F.base64(F.aes_encrypt(_col(text), k, F.lit("GCM")))


def decrypt_text(token, key) -> Column:
    k = key if isinstance(key, Column) else F.lit(key)
    return F.aes_decrypt(F.unbase64(_col(token)), k, F.lit("GCM")).cast("string")


def read_key(path: str) -> bytes:
    """The cipher key in a key file of the caller."""
    with open(path, "rb") as handle:
        return handle.read().strip()
