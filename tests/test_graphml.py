import itertools
import random
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest

from alpenglow.errors import DataError
from alpenglow.plans.landscape import build
from alpenglow.sources import store


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_by_executors(spark, tmp_path):
    rng = random.Random(5)
    cfgs = list(itertools.product(['a"<', "b&c", "d>'e"], range(3), range(4)))
    df = spark.createDataFrame([(*c, float(rng.randrange(6))) for c in cfgs], "name string, b int, c int, fitness double")
    land = build(df, {"name": "categorical", "b": "categorical", "c": "ordinal"}, maximize=False, epsilon=1.0)
    path = store.write_graphml(land, f"{tmp_path}/g")
    parts = sorted(Path(path).glob("part-*"))
    tree = ET.fromstring("\n".join(p.read_text() for p in parts))  # parts in order are one document
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(tree.findall(f"{ns}graph/{ns}node")) == land.n_configs and len(tree.findall(f"{ns}graph/{ns}edge")) == land.n_edges and len(parts) > 3
    back = store.from_graphml(spark, path)
    assert "plateaus" in back.__dict__  # read, not computed
    assert back.describe() == land.describe()
    for name in ("nodes", "edges", "neutral", "plateaus", "optima", "basins", "exits"):
        a, b = getattr(land, name), getattr(back, name)
        assert rows(a) == rows(b.select(a.columns)), name


def test_a_file_that_others_wrote(spark, tmp_path):
    """No settings, no codes, no gains, other ids: all inferred."""
    text = """<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="f" for="node" attr.name="fitness" attr.type="double"/>
<key id="a" for="node" attr.name="a" attr.type="string"/><key id="b" for="node" attr.name="b" attr.type="long"/><key id="c" for="node" attr.name="c" attr.type="int"/>
<graph edgedefault="directed">"""
    cells = list(itertools.product("xy", (0, 1), (3, 5, 9)))
    f = [float(i * 5 % 12) for i in range(12)]
    text += "".join(f'<node id="n{i}"><data key="a">{a}</data><data key="b">{b}</data><data key="c">{c}</data><data key="f">{v}</data></node>' for i, ((a, b, c), v) in enumerate(zip(cells, f)))
    near = lambda p, q: sum(x != y for x, y in zip(p, q)) == 1 and abs((3, 5, 9).index(p[2]) - (3, 5, 9).index(q[2])) < 2
    text += "".join(f'<edge source="n{i}" target="n{j}"/>' for i, j in itertools.permutations(range(12), 2) if f[i] > f[j] and near(cells[i], cells[j])) + "</graph></graphml>"
    (tmp_path / "other.graphml").write_text(text)
    back = store.from_graphml(spark, f"{tmp_path}/other.graphml")
    df = spark.createDataFrame([(*c, v) for c, v in zip(cells, f)], "a string, b int, c int, fitness double")
    want = build(df, {"a": "categorical", "b": "boolean", "c": "ordinal"}, maximize=False)
    assert not back.maximize and [(v.name, v.kind, v.levels) for v in back.variables] == [("a", "categorical", 2), ("b", "boolean", 2), ("c", "ordinal", 3)]
    assert rows(back.edges) == rows(want.edges) and rows(back.optima) == rows(want.optima)
    (tmp_path / "none.graphml").write_text('<graphml><key id="a" for="node" attr.name="a" attr.type="string"/><graph/></graphml>')
    with pytest.raises(DataError):
        store.from_graphml(spark, f"{tmp_path}/none.graphml")
