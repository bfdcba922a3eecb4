"""Chunks of any size give the elements of a plain reading of the whole document."""

import random

import pytest

from logquarry.sources import xmlnodes as xn
from tests.helpers import line_table
from tests.test_config_hip import CONFIG

BROKEN = "<config><a><b>1</c></a>\n<d x=5 y='6' z=\"7>8\">kept & kept?</d>\n</e></config>\n<late/>"
LONG_TAGS = """<?xml version="1.0"?>
<!-- <none>
 <of> these
--> <r><a
 name="x"
 other='y'
>t1
 t2</a><![CDATA[ <raw> &amp;
 </raw> ]]><b k="&lt;&#65;&#x42;&unknown;"/>
<!-- one --> 1 < 2 </r>"""


def plain(text):
    """{node_id: (parent, depth, tag, nth, attrs, text, collected, has elements)} by one stack over the whole text."""
    stack, out, count, status, root = [], {}, 0, [0, 0], False

    def close():
        e = stack.pop()
        named = [k["attrs"].get("name", k["all"]) for k in e["kids"] if k["tag"] == "entry"]
        members = [" ".join(k["text"]) for k in e["kids"] if k["tag"] == "member"]
        own = " ".join(e["text"])
        e["all"] = ", ".join(members) if members else ", ".join(named) if named else own or ", ".join(k["all"] for k in e["kids"] if k["all"])
        out[e["id"]] = (e["parent"], len(stack), e["tag"], e["nth"], e["attrs"], own, e["all"], any(k["tag"] != "member" for k in e["kids"]))

    for kind, value, attrs in xn.events(text):
        if root and not stack:
            break
        if kind == "start":
            kids = stack[-1]["kids"] if stack else []
            e = {"id": count, "tag": value, "attrs": attrs, "nth": sum(k["tag"] == value for k in kids), "parent": stack[-1]["id"] if stack else None, "kids": [], "text": []}
            kids.append(e)
            stack.append(e)
            count, root = count + 1, True
        elif kind == "text" and stack:
            stack[-1]["text"].append(value)
        elif kind == "end":
            if any(e["tag"] == value for e in stack):
                while stack[-1]["tag"] != value:
                    close()
                close()
            else:
                status[0] += 1
    status[1] = len(stack)
    while stack:
        close()
    return out, status


def read(df):
    return {r.node_id: (r.parent_id, r.depth, r.tag, r.nth, r.attrs, r.text, r.collected, r.has_elements) for r in df.collect()}


def trees(seed, lines):
    rnd, out, stack = random.Random(seed), ["<root>"], ["root"]
    for _ in range(lines):
        said = ""
        for _ in range(rnd.randrange(4)):
            pick = rnd.random()
            if pick < 0.35 and len(stack) < 7:
                stack.append(rnd.choice(["entry", "member", "x", "y"]))
                said += f'<{stack[-1]} name="n{rnd.randrange(9)}">' if rnd.random() < 0.5 else f"<{stack[-1]}>"
            elif pick < 0.65 and len(stack) > 1:
                said += f"</{stack.pop()}>"
            elif pick < 0.7:
                said += f"</{rnd.choice(['x', 'y', 'zz', 'entry'])}>"  # often the wrong one
            elif pick < 0.8:
                said += "<member>m</member><entry name='e'/>"
            else:
                said += f" t{rnd.randrange(99)} "
        out.append(said)
    return "\n".join([*out, "</root>", "<after/>"] if seed % 2 else out)


@pytest.mark.parametrize("chunk_lines", [1, 3, 65536])
def test_any_chunks_give_the_elements_of_a_plain_reading(spark, chunk_lines):
    texts = {"config.xml": CONFIG, "broken.xml": BROKEN, "long.xml": LONG_TAGS, "none.xml": "", "prose.xml": "a < b\nno tags"}
    texts |= {f"t{seed}.xml": trees(seed, 25 * seed) for seed in range(1, 7)}
    lines = line_table(spark, texts)
    nodes = xn.xml_nodes(lines, chunk_lines).cache()
    status = {r.path: r for r in xn.xml_status(lines, chunk_lines).collect()}
    assert set(status) == set(texts)
    for path, text in texts.items():
        want, (ignored, unclosed) = plain(text)
        assert read(nodes.where(nodes.path == path)) == want, path
        assert (status[path].ignored_ends >= ignored) and status[path].unclosed == unclosed, path
    parents = {(r.path, r.node_id): r for r in nodes.collect()}
    for r in parents.values():
        above = parents.get((r.path, r.parent_id))
        assert r.parent_has_elements == (above is None or above.has_elements)
        assert r.parent_nth == (above.nth if above else 0) and r.ord == r.node_id and r.name == r.attrs.get("name")
        assert r.tags == ((above.tags if above else []) + [r.tag]) and r.ids == ((above.ids if above else []) + [r.node_id])


def test_malformed_documents_keep_what_follows(spark):
    nodes = read(xn.xml_nodes(line_table(spark, {"b.xml": BROKEN})))
    assert [(v[2], v[5]) for _, v in sorted(nodes.items())] == [("config", ""), ("a", ""), ("b", "1"), ("d", "kept & kept?")]
    assert nodes[3][4] == {"x": "5", "y": "6", "z": "7>8"}
    long = read(xn.xml_nodes(line_table(spark, {"l.xml": LONG_TAGS}), 2))
    assert [v[2] for _, v in sorted(long.items())] == ["r", "a", "b"]
    assert long[1][4] == {"name": "x", "other": "y"} and long[1][5] == "t1 t2" and long[2][4] == {"k": "<AB&unknown;"}
    assert long[0][5] == "<raw> &amp; </raw> 1 < 2"


def test_one_long_document_is_spread(spark):
    rows = 20_000
    text = "<config><list>\n" + "\n".join(f'<entry name="e{i}"><member>{i}</member></entry>' for i in range(rows)) + "\n</list></config>"
    nodes = xn.xml_nodes(line_table(spark, {"c.xml": text}), 1000)
    got = nodes.where("tag = 'entry'").selectExpr("count(*) as n", "max(nth) as last", "count(distinct node_id) as ids", "min(parent_id) as p").first()
    assert tuple(got) == (rows, rows - 1, rows, 1)
    whole = nodes.where("tag = 'list'").first()
    assert whole.collected.split(", ") == [f"e{i}" for i in range(rows)] and whole.has_elements
