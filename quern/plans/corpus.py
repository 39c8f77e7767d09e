"""Python sources derived from the documents, for queries that need real code.

Every document becomes one file that contains its whole text, as a docstring or as comments.
Ten templates, chosen by ``doc_id % 10``, cover the cases that cleaning and sample building tell
apart.  A template is text with placeholders; it is turned into one SQL expression that Spark
and other engines read alike, so expected results can be stated in plain SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

TEXT = "text"
PLACEHOLDERS = {
    "id": "CAST(doc_id AS STRING)",
    # Text inside triple quotes.
    "doc": "replace({text}, '\"', '^')",
    # Further comment lines, with and without a blank after the hash sign.
    "cmt": "replace({text}, chr(10), concat(chr(10), '# '))",
    "tight": "replace({text}, chr(10), concat(chr(10), '#'))",
    # Dummy secrets, assembled so that none stands in this file.
    "mail": "concat('admin', CAST(doc_id AS STRING), '@', 'example.org')",
    "host": "concat('10.20.', '30.40')",
    "key": "concat('AKIA', 'ABCDEFGHIJ', '012345')",
    "begin": "concat('-----BEGIN RSA', ' PRIVATE KEY-----')",
    "end": "concat('-----END RSA', ' PRIVATE KEY-----')",
    "many": "repeat(concat('value = ', CAST(doc_id AS STRING), chr(10)), 480)",
    "tab": "chr(9)",
}


def sql_text(template: str, text: str = TEXT, **more: str) -> str:
    """SQL expression for a template; ``text`` is the expression that stands for the text."""
    values = {**PLACEHOLDERS, **more}
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            parts.append(values[piece[1:-1]].replace("{text}", text))
        elif piece:
            parts.append(f"'{piece}'")
    return f"concat({', '.join(parts)})"


def by_template(templates: dict[int, str], text: str = TEXT) -> str:
    cases = " ".join(f"WHEN {k} THEN {sql_text(t, text)}" for k, t in templates.items())
    return f"CASE doc_id % 10 {cases} END"


FILE_PATH = "concat(source, '/mod_', CAST(doc_id AS STRING), '.py')"

SOURCES = {
    0: '''"""{doc}"""
import os
import json.decoder


def get_item_{id}(key, default):
    """Return the item {id} or the default."""
    value = os.environ.get(key)
    if value is None:
        value = default
    parts = [value, str({id})]
    total = 0
    for part in parts:
        total = total + len(part)
    return total
''',
    1: '''# {cmt}
class Shape{id}:
    def get_area(self):
        return self.width * self.height

    def set_width(self, width):
        self.width = width

    def is_open(self):
        return self.width > {id}

    def has_height(self):
        return self.height > 0

    def scale(self, factor, *extra, offset=0):
        self.width = self.width * factor

    def reset(self):
        self.width = 0

    def close(self):
        self.height = 0
''',
    2: '''# {cmt}
def broken_{id}(:
    return 1
''',
    3: '''# {cmt}

a = {id}
b = 2
c = 3

# middle
d = 4
e = 5
f = 6
g = 7
h = 8
i = 9
''',
    4: '''# {begin}
# MIIB{id}
# {end}
import logging
from os import path


# Lookup {id}: mail {mail}, host {host}, key {key}
# {cmt}
def lookup_{id}(table, name, /, *, strict):
    found = table.get(name)
    if found is None and strict:
        raise KeyError(name)
    logging.debug(found)
    shown = str(found)
    size = len(shown)
    return path.join(shown, str(size))
''',
    5: '''#!/usr/bin/env python
# -*- coding: utf-8 -*-
#{tight}
#
x_{id} = 1{tab}#tail  
def run_{id}(items):
{tab}total = 0   
{tab}for item in items:
{tab}{tab}total += item   #  sum
{tab}return total


y = 2
z = 3
v = "a{tab}b"
w = run_{id}([x_{id}, y, z])
print(w)


''',
    6: '''"""Helpers {id}: {doc}"""


def __init__(self):
    self.value = {id}
    return self


def set_value(self, value):
    self.value = value
    return self


def calcsum(a, b):
    total = a + b
    return total


def parse_line_{id}(line):
    parts = line.split()
    return parts


def plain():
    value = {id}
    return value


def is_(x):
    same = x is None
    return same


def load_{id}():
    value = [{id}]
    return value


def test_{id}(a):
    value = a
    return value
''',
    7: '''def process_all(items, limit):
    """Process all items up to a limit and return the total."""
    total = 0
    seen = set()
    for item in items:
        if item in seen:
            continue
        if len(seen) >= limit:
            break
        seen.add(item)
        total = total + item
    return total


# {cmt}
''',
    8: '''from . import sibling
from .pkg.mod import thing
import numpy as np, os.path


async def fetch_{id}(url):
    """Fetch the page {id}."""
    data = await url.read()
    return data


# not right above the function
@thing.cached
def outer_{id}(a, b):
    def inner(x):
        return x + {id}

    total = inner(a) + inner(b)
    return total


# {cmt}
''',
    9: '''"""{doc}"""
{many}

def tail_{id}(rows):
    return [row for row in rows if row.key == {id}]
''',
}


def odd_files(docs: DataFrame) -> DataFrame:
    """(file_path, source): a file without text for every fiftieth document."""
    path = F.concat(F.lit("odd/none_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return docs.filter(F.col("doc_id") % 50 == 0).select(
        path.alias("file_path"), F.lit(None).cast("string").alias("source")
    )


def code_files(docs: DataFrame) -> DataFrame:
    """(file_path, source) for every document."""
    return docs.select(
        F.expr(FILE_PATH).alias("file_path"), F.expr(by_template(SOURCES)).alias("source")
    )


def earlier_files(docs: DataFrame) -> DataFrame:
    """The code corpus before it changed: of every 7th file another text, of every 13th none yet."""
    changed = F.col("doc_id") % 7 == 0
    source = F.expr(by_template(SOURCES))
    return docs.filter(F.col("doc_id") % 13 != 0).select(
        F.expr(FILE_PATH).alias("file_path"),
        F.when(changed, F.concat(source, F.lit("# earlier\n"))).otherwise(source).alias("source"),
    )


def later_files(docs: DataFrame) -> DataFrame:
    """The code corpus after it changed: every 11th file is gone."""
    return code_files(docs.filter(F.col("doc_id") % 11 != 0))
