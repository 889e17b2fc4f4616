"""Document information of PDFs, extracted with regular expressions over the byte column.

Objects stored in compressed object streams are not opened.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filetrail.functions.binary import let

_OBJECT = r"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj"
# Escapes of literal strings.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_SPECIAL = re.compile(r"[\\()]")
_ESCAPE = re.compile(r"\\([0-7]{1,3}|\r\n|[\s\S])")


def pdf_string(body: str, name: str) -> str | None:
    """The text string of an entry `/name` in a dictionary (bytes as Latin-1): literal with balanced parentheses, or
    hexadecimal; UTF-16 and UTF-8 by their marks. NULL if there is none or it is empty or does not end.
    """
    found = re.search(rf"/{name}\s*(?=[(<])", body)
    if not found or body.startswith("<<", found.end()):
        return None
    at = found.end()
    if body[at] == "<":
        end = body.find(">", at)
        digits = re.sub(r"[^0-9A-Fa-f]", "", body[at + 1:end if end >= 0 else at + 1])
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        depth, end = 0, -1
        position = at
        while mark := _SPECIAL.search(body, position):
            position = mark.end()
            if mark[0] == "\\":
                position += 1
            else:
                depth += 1 if mark[0] == "(" else -1
                if depth == 0:
                    end = mark.start()
                    break
        if end < 0:
            return None

        def plain(escape: re.Match) -> str:
            code = escape[1]
            if code[0] in "01234567":
                return chr(int(code, 8) & 255)
            return "" if code[0] in "\r\n" else _ESCAPES.get(code, code)

        raw = _ESCAPE.sub(plain, body[at + 1:end]).encode("latin-1")
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace") or None
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace") or None
    return raw.decode("latin-1") or None


@F.pandas_udf(T.StructType([T.StructField("producer", T.StringType()), T.StructField("creator", T.StringType())]))
def pdf_strings(bodies: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if b is None else (pdf_string(b, "Producer"), pdf_string(b, "Creator")) for b in bodies]
    return pd.DataFrame(rows, columns=["producer", "creator"], dtype="object")


def pdf_parts(content: Column) -> Column:
    """struct<info, fonts array<struct<name, embedded>>>: the information dictionary as text, and the fonts.

    The information dictionary is the one the last trailer points to. Font names lose their subset prefix; a
    font is embedded if its descriptor object names a font file. `pdf_strings` reads producer and creator out of the
    dictionary, from a staged column: the expression here cannot feed a Python function in the same step.
    """
    def read(text: Column) -> Column:
        objects = F.zip_with(
            F.regexp_extract_all(text, F.lit(_OBJECT), 1), F.regexp_extract_all(text, F.lit(_OBJECT), 2),
            lambda number, body: F.struct(number.alias("number"), body.alias("body")),
        )
        info_id = F.try_element_at(F.regexp_extract_all(text, F.lit(r"/Info\s+(\d+)\s+\d+\s+R"), 1), F.lit(-1))

        def body_of(bodies: Column, number: Column) -> Column:
            return F.try_element_at(F.filter(bodies, lambda o: o["number"] == number), F.lit(-1))["body"]

        def font(bodies: Column, body: Column) -> Column:
            descriptor = body_of(bodies, F.regexp_extract(body, r"/FontDescriptor\s+(\d+)\s+\d+\s+R", 1))
            name = F.regexp_extract(body, r"/BaseFont\s*/([^\s/<>\[\]()]+)", 1)
            return F.struct(
                F.regexp_replace(name, r"^[^+]*\+", "").alias("name"),
                F.coalesce(descriptor.rlike(r"/FontFile[23]?\b"), F.lit(False)).alias("embedded"),
            )

        def fonts(bodies: Column) -> Column:
            listed = F.filter(
                bodies, lambda o: o["body"].rlike(r"/Type\s*/Font\b(?!\w)") & o["body"].contains("/BaseFont")
            )
            return F.transform(listed, lambda o: font(bodies, o["body"]))

        def fields(bodies: Column) -> Column:
            info = body_of(bodies, info_id)
            return F.struct(info.alias("info"), fonts(bodies).alias("fonts"))

        return let(objects, fields)

    return let(F.decode(content, "ISO-8859-1"), read)
