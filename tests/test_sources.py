"""Readers against files with broken records, many roots and capped archives; communities on a hand graph."""

import zipfile
from io import BytesIO

from weftline.operators import communities
from weftline.sources import flows, mappings


def test_a_broken_folder_leaves_later_ones_readable(spark, tmp_path):
    good = '<FOLDER NAME="{0}"><SESSION NAME="s_{0}" MAPPINGNAME="m"><ATTRIBUTE NAME="Pre SQL" VALUE="x"/></SESSION></FOLDER>'
    (tmp_path / "a.xml").write_text("<REPOSITORY>" + good.format("A") + '<FOLDER NAME="B"><SESSION NAME="s_B" MAPPINGNAME="m"></FOLDER>' + good.format("C") + "</REPOSITORY>")
    (tmp_path / "b.xml").write_text("<REPOSITORY>" + good.format("D") + "</REPOSITORY>")
    audit = {r.status: (r.folders, r.sessions) for r in mappings.ingest_audit(spark, str(tmp_path)).collect()}
    assert audit["ok"][0] >= 2 and audit["all"][0] >= audit["ok"][0]
    names = {r.session for r in mappings.pre_post_sql(mappings.read_folders(spark, str(tmp_path))).collect()}
    assert {"s_A", "s_D"} <= names


def test_lookups_prefer_the_attribute(spark, tmp_path):
    def lookup(name, *pairs):
        return f'<TRANSFORMATION NAME="{name}" TYPE="Lookup Procedure">' + "".join(f'<TABLEATTRIBUTE NAME="{k}" VALUE="{v}"/>' for k, v in pairs) + "</TRANSFORMATION>"

    body = lookup("l1", ("Lookup table name", "dim_a"), ("Lookup Sql Override", "SELECT 1 FROM other")) + lookup("l2", ("Lookup Sql Override", "select x from  dw.dim_b where 1")) + lookup("l3", ("Lookup table name", "$Param")) + lookup("l4", ("Lookup table name", "ab")) + lookup("l5")
    (tmp_path / "a.xml").write_text(f'<FOLDER NAME="F">{body}</FOLDER>')
    found = {(r.transform, r.tname) for r in mappings.lookup_tables(mappings.read_folders(spark, str(tmp_path))).collect()}
    assert found == {("l1", "DIM_A"), ("l2", "DW.DIM_B")}


def test_archives_are_capped(spark):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/", "")
        for k in range(5):
            z.writestr(f"d/{k}.{'txt' if k == 1 else 'XML'}", "x" * 100)
    rows = spark.createDataFrame([("a", bytearray(out.getvalue()))], "archive string, content binary")
    assert [r.member for r in flows.zip_members(rows, 350).orderBy("member").collect()] == ["d/0.XML", "d/2.XML"]
    assert flows.zip_members(rows, 10**6).count() == 4 and flows.zip_members(rows.limit(0), 10).count() == 0


def test_two_cliques_are_two_communities(spark):
    pairs = [(a, b, 1.0) for g in ("abcde", "vwxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("e", "v", 0.2)]
    nodes = spark.createDataFrame([(n,) for n in "abcdevwxyzq"], "node string")
    found = {r.node: r.cluster for r in communities.louvain(nodes, spark.createDataFrame(pairs, "a string, b string, sim double")).collect()}
    assert found == {n: "a" if n in "abcde" else "q" if n == "q" else "v" for n in "abcdevwxyzq"}
    alone = communities.louvain(nodes, spark.createDataFrame([], "a string, b string, sim double")).collect()
    assert all(r.node == r.cluster for r in alone)


def test_containers_that_hold_each_other(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<REPOSITORY><FOLDER NAME="A">
      <TRANSFORMATION NAME="lkp_c" TYPE="Lookup Procedure"><TABLEATTRIBUTE NAME="Lookup table name" VALUE="common"/><TABLEATTRIBUTE NAME="Lookup condition" VALUE="a = b"/></TRANSFORMATION>
      <WORKLET NAME="x"><TASKINSTANCE TASKTYPE="Worklet" REFERENCETASKNAME="y"/><TASKINSTANCE TASKTYPE="SESSION" REFERENCETASKNAME="s1"/></WORKLET>
      <WORKLET NAME="y"><TASKINSTANCE TASKTYPE="worklet" REFERENCETASKNAME="x"/><TASKINSTANCE TASKTYPE="Session" REFERENCETASKNAME="s2"/><TASKINSTANCE TASKTYPE="Session"/><TASKINSTANCE TASKTYPE="Worklet" REFERENCETASKNAME="gone"/></WORKLET>
      <WORKLET NAME="empty"></WORKLET>
      <MAPPLET NAME="p"><INSTANCE NAME="i" TYPE="SOURCE" TRANSFORMATION_NAME="s"><ASSOCIATED_SOURCE_INSTANCE NAME="t"/></INSTANCE><INSTANCE NAME="q" TYPE="MAPPLET"/></MAPPLET>
      <MAPPLET NAME="Q"><INSTANCE NAME="l" TYPE="TRANSFORMATION" TRANSFORMATION_NAME="lkp_c" TRANSFORMATION_TYPE="Lookup Procedure"/><INSTANCE NAME="p" TYPE="MAPPLET" TRANSFORMATION_NAME="P"/></MAPPLET>
      <MAPPING NAME="m"><INSTANCE NAME="use" TYPE="MAPPLET" TRANSFORMATION_NAME="q"/><TRANSFORMATION NAME="r" TYPE="Router"><GROUP NAME="g"/><GROUP EXPRESSION="lost"/></TRANSFORMATION><TRANSFORMATION NAME="f" TYPE="Filter"><TABLEATTRIBUTE NAME="Filter Condition" VALUE=" "/></TRANSFORMATION></MAPPING>
    </FOLDER><FOLDER NAME="B"><WORKLET NAME="y"><TASKINSTANCE TASKTYPE="Session" REFERENCETASKNAME="other"/></WORKLET></FOLDER></REPOSITORY>""")
    folders = mappings.read_folders(spark, str(tmp_path))
    assert {tuple(r) for r in mappings.worklet_sessions(folders).collect()} == {("x", "s1"), ("x", "s2"), ("y", "s1"), ("y", "s2"), ("y", "other")}
    assert {tuple(r) for r in mappings.mapplet_tables(folders).collect()} == {("m", "source", "S"), ("m", "source", "T"), ("m", "lookup", "COMMON")}
    assert {tuple(r) for r in mappings.conditions(folders).collect()} == {(None, "lkp_c", "lookup", "a = b", "common"), ("m", "r", "router", "", "g")}
