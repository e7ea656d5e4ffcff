"""All queries of the catalogue under the database's collation, by their rows: texts in capitals in half of the rows change nothing."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF
from foliospark.catalog import registry
from foliospark.functions.collation import DATABASE, collated
from foliospark.sources.bridge import VIEWS, editorial_tables


def folded(cell):
    """A text's letters without case and accents, in any order, as lists are in the order of the collation."""
    if not isinstance(cell, str):
        return repr(round(cell, 6)) if isinstance(cell, float) else repr(cell)
    return "".join(sorted(c for c in unicodedata.normalize("NFKD", cell).casefold() if not unicodedata.combining(c)))


def rows(frame):
    return sorted(tuple(map(folded, r)) for r in frame.collect())


@pytest.fixture(scope="module")
def both(spark):
    """The tables as they are, and with all texts of every other row in capitals; held in memory."""
    own, shouted = {}, {}
    for name in VIEWS:
        table = editorial_tables(spark, SF).table(name)
        odd = F.pmod(F.xxhash64(F.col(table.columns[0])), F.lit(2)) == 1
        own[name] = table.cache()
        texts = {f.name for f in table.schema if isinstance(f.dataType, T.StringType)}
        shouted[name] = table.select(*[F.when(odd, F.upper(c)).otherwise(F.col(c)).alias(c) if c in texts else F.col(c) for c in table.columns]).cache()
    yield own, shouted
    for table in (*own.values(), *shouted.values()):
        table.unpersist()


#: Queries whose rows differ under the collation by what they ask: an ISSN's small x is right there.
DIFFERENT = {"REV-META-002"}


@pytest.mark.parametrize("code", registry.CATALOGUE)
def test_case_changes_no_rows(both, code):
    own, shouted = both
    got = rows(registry.frame(code, shouted.__getitem__, collation=DATABASE))
    assert got == rows(registry.frame(code, own.__getitem__, collation=DATABASE))
    if code not in DIFFERENT:
        assert got == rows(registry.frame(code, own.__getitem__))


def test_capitals_matter_without_it(both):
    own, shouted = both
    changed = [c for c in ("AUT-REV-003", "AUT-EST-001", "ART-WF-001", "REV-EST-001") if rows(registry.frame(c, shouted.__getitem__)) != rows(registry.frame(c, own.__getitem__))]
    assert len(changed) == 4 and collated(shouted["autores"]).schema["estado_autor"].dataType != T.StringType()
