import pytest
from pyspark.sql import Row

from quern.document import Document
from quern.errors import DocumentValidationError
from quern.types import GeoPoint


def test_access():
    d = Document(Row(a="x", n=1.5, b=True, s=["p"], m=Row(n=[1, 2], at=Row(lat=1.0, lon=2.0)), none=None))
    assert (d.get_string("a"), d.get_number("n"), d.get_bool("b"), d.get_string_list("s"), d.get_number_list("m.n")) == ("x", 1.5, True, ["p"], [1, 2])
    assert d.get_geo_point("m.at") == GeoPoint(1, 2) and d.get_nested("m").get_number_list("n") == [1, 2]
    assert d.try_string("n") is None and d.try_number("b") is None and d.try_bool("none") is None and d.try_string("a.b") is None
    for bad in (lambda: d.get_string("n"), lambda: d.get_number("none"), lambda: d.get_bool("zz"), lambda: d.get_nested("a")):
        with pytest.raises(DocumentValidationError):
            bad()
    with pytest.raises(TypeError):
        d.to_map()["a"] = 1
