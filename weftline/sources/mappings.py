"""Mapping exports: a Spark job that writes them from a catalog, readers with explicit schemas, and what they hold.

An export has a FOLDER element for each batch of sessions and a file for each few of them, so neither grows
with the data. A folder holds
transformations, mappings (instances, connectors, transformations of their own), mapplets and worklets (both may hold
others of their kind, even in a circle), sessions (attributes, connections, overrides), schedulers, configs, source
and target definitions and a workflow. Attribute names follow the export format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.shared import stored


def _element(attributes: str, **children: T.DataType) -> T.StructType:
    """A struct of string attributes and of lists of child elements."""
    fields = [T.StructField(f"_{a}", T.StringType()) for a in attributes.split()]
    return T.StructType(fields + [T.StructField(name, T.ArrayType(kind)) for name, kind in children.items()])


_ATTRIBUTE = _element("NAME VALUE")
_TRANSFORMATION = _element("NAME TYPE", TABLEATTRIBUTE=_ATTRIBUTE, GROUP=_element("NAME EXPRESSION"))
_INSTANCE = _element("NAME TYPE TRANSFORMATION_NAME TRANSFORMATION_TYPE", ASSOCIATED_SOURCE_INSTANCE=_element("NAME"))
FOLDER = _element(
    "NAME OWNER",
    SOURCE=_element("NAME DATABASETYPE DBDNAME", SOURCEFIELD=_element("NAME DATATYPE KEYTYPE")), TARGET=_element("NAME DATABASETYPE", TARGETFIELD=_element("NAME DATATYPE KEYTYPE")),
    TRANSFORMATION=_TRANSFORMATION, MAPPLET=_element("NAME", INSTANCE=_INSTANCE, TRANSFORMATION=_TRANSFORMATION),
    WORKLET=_element("NAME", TASKINSTANCE=_element("TASKTYPE REFERENCETASKNAME")),
    MAPPING=_element("NAME ISVALID", INSTANCE=_INSTANCE, TRANSFORMATION=_TRANSFORMATION, CONNECTOR=_element("FROMINSTANCE FROMFIELD TOINSTANCE TOFIELD")),
    SESSION=_element("NAME MAPPINGNAME CONFIGREFERENCE", ATTRIBUTE=_ATTRIBUTE, SESSTRANSFORMATIONINST=_element("TRANSFORMATIONNAME", ATTRIBUTE=_ATTRIBUTE, CONNECTIONREFERENCE=_element("CONNECTIONNAME CONNECTIONSUBTYPE"))),
    SCHEDULER=_element("NAME", SCHEDULEINFO=_element("SCHEDULETYPE FREQUENCY")), CONFIG=_element("NAME", ATTRIBUTE=_ATTRIBUTE),
    WORKFLOW=_element("NAME SCHEDULERREFERENCE", TASKINSTANCE=_element("TASKNAME"), WORKFLOWLINK=_element("FROMTASK TOTASK CONDITION")),
).add("_corrupt_record", T.StringType())
REPOSITORY = _element("NAME VERSION CODEPAGE DATABASETYPE")


def _tag(name: str, body: Column | str = "", **attributes) -> Column:
    """An element as text; attribute values are columns or strings, null ones are left out."""
    parts = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        value = F.lit(value) if isinstance(value, str) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f' {key}="'), value, F.lit('"')), F.lit("")))
    body = F.lit(body) if isinstance(body, str) else body
    return F.concat(*parts, F.lit(">"), body, F.lit(f"</{name}>"))


def _joined(column: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_list(column)), "")


def _conditional(k: Column) -> Column:
    """Transformations of a mapping that hold conditions, by its number."""
    attribute = lambda name, value: _tag("TABLEATTRIBUTE", NAME=name, VALUE=value)
    of = lambda prefix, kind, body: _tag("TRANSFORMATION", body, NAME=F.concat(F.lit(prefix), k), TYPE=kind)
    joiner = of("JNR_", "Joiner", F.concat(attribute("Join Condition", F.concat(F.lit("A.id = B.id"), k % 4)), attribute("Join Type", "Normal Join")))
    chosen = of("FIL_", "Filter", attribute("Filter Condition", F.concat(F.lit("AMT &lt; "), k % 100)))
    router = of("RTR_", "Router", F.concat(_tag("GROUP", NAME="G1", EXPRESSION=F.concat(F.lit("X = "), k % 7)), _tag("GROUP", NAME="DEFAULT1", EXPRESSION=F.lit(None).cast("string"))))
    query = of("SQ_", "Source Qualifier", attribute("Sql Query", F.concat(F.lit("SELECT a FROM T"), k % 9)))
    return F.concat(*[F.when(k % n == r, x).otherwise("") for n, r, x in ((3, 0, joiner), (4, 1, chosen), (5, 2, router), (6, 4, query))])


def _containers(b: Column) -> Column:
    """Two mapplets and three worklets of a batch; each holds the next, and in every second or third batch the last the first."""
    name = lambda kind, i: F.concat(F.lit(kind), b, F.lit(f"_{i}"))
    instance = lambda n, kind, of, what: _tag("INSTANCE", NAME=n, TYPE=kind, TRANSFORMATION_NAME=of, TRANSFORMATION_TYPE=what)
    inner = lambda i: instance("MPLT", "MAPPLET", name("mp_", i), "Mapplet")
    looked = F.concat(F.lit("ML_"), b)
    lookup = _tag("TRANSFORMATION", _tag("TABLEATTRIBUTE", NAME="Lookup table name", VALUE=looked), NAME="lkp_inner", TYPE="Lookup Procedure")
    first = F.concat(instance("SQ", "SOURCE", F.concat(F.lit("MS_"), b), "Source Definition"), instance("LKP", "TRANSFORMATION", F.lit("lkp_inner"), "Lookup Procedure"), lookup, inner(1))
    second = F.concat(instance("TGT", "TARGET", F.concat(F.lit("MT_"), b), "Target Definition"), F.when(b % 3 == 0, inner(0)).otherwise(""))
    nested = lambda i: _tag("TASKINSTANCE", TASKTYPE="Worklet", REFERENCETASKNAME=name("wl_", i))
    lets = [F.concat("w0", nested(1)), F.concat("w1", nested(2)), F.concat("w2", F.when(b % 2 == 0, nested(0)).otherwise(""))]
    return F.concat(_tag("MAPPLET", first, NAME=name("mp_", 0)), _tag("MAPPLET", second, NAME=name("mp_", 1)), *[_tag("WORKLET", x, NAME=name("wl_", i)) for i, x in enumerate(lets)])


def write_exports(sessions: DataFrame, access: DataFrame, folder: str, batch: int = 20, per_file: int = 25) -> None:
    """Write the exports of ``sessions`` (sid, k) and ``access`` below ``folder``: FOLDER elements of at most ``batch``
    sessions, ``per_file`` of them a file."""
    t, k = F.col("tname"), F.col("k")
    instance = F.when(F.col("role") == "source", _tag("INSTANCE", NAME=F.concat(F.lit("SQ_"), t), TYPE="SOURCE", TRANSFORMATION_NAME=t, TRANSFORMATION_TYPE="Source Definition")).when(
        F.col("role") == "target", _tag("INSTANCE", NAME=F.concat(F.lit("TGT_"), t), TYPE="TARGET", TRANSFORMATION_NAME=t, TRANSFORMATION_TYPE="Target Definition")).otherwise(
        _tag("INSTANCE", NAME=F.concat(F.lit("LKP_"), t), TYPE="TRANSFORMATION", TRANSFORMATION_NAME=F.concat(F.lit("lkp_"), t), TRANSFORMATION_TYPE="Lookup Procedure"))
    override = F.ascii(F.substring(t, -1, 1)) % 2 == 1
    attribute = F.when(override, _tag("TABLEATTRIBUTE", NAME="Lookup Sql Override", VALUE=F.concat(F.lit("SELECT a FROM "), t))).otherwise(_tag("TABLEATTRIBUTE", NAME="Lookup table name", VALUE=t))
    lookup = F.when(F.col("role") == "lookup", _tag("TRANSFORMATION", attribute, NAME=F.concat(F.lit("lkp_"), t), TYPE="Lookup Procedure"))
    source = F.when(F.col("role") == "source", _tag("SOURCE", _tag("SOURCEFIELD", NAME="id", DATATYPE="integer", KEYTYPE="PRIMARY KEY"), NAME=t, DATABASETYPE="Oracle", DBDNAME="DW"))
    target = F.when(F.col("role") == "target", _tag("TARGET", _tag("TARGETFIELD", NAME="id", DATATYPE="integer", KEYTYPE="NOT A KEY"), NAME=t, DATABASETYPE="Teradata"))
    wired = access.where("role = 'source'").select("sid", F.col("tname").alias("s")).join(access.where("role = 'target'").select("sid", F.col("tname").alias("t")), "sid")
    wire = _tag("CONNECTOR", FROMINSTANCE=F.concat(F.lit("SQ_"), "s"), FROMFIELD="id", TOINSTANCE=F.concat(F.lit("TGT_"), "t"), TOFIELD="id")
    inner = access.groupBy("sid").agg(_joined(instance).alias("instances"), _joined(F.coalesce(lookup, source, target)).alias("defined"))
    rows = sessions.select("sid", "k").join(inner, "sid", "left").join(wired.groupBy("sid").agg(_joined(wire).alias("wires")), "sid", "left")
    b = F.floor(k / batch).cast("long")
    used = F.when(k % 6 == 0, 0).when(k % 6 == 3, 1)
    uses = F.when(used.isNotNull(), _tag("INSTANCE", NAME="MPLT", TYPE="MAPPLET", TRANSFORMATION_NAME=F.concat(F.lit("mp_"), b, F.lit("_"), used), TRANSFORMATION_TYPE="Mapplet")).otherwise("")
    mapping = _tag("MAPPING", F.concat(F.coalesce("instances", F.lit("")), uses, _conditional(k), F.coalesce("wires", F.lit(""))), NAME=F.concat(F.lit("m_"), k), ISVALID=F.when(k % 13 == 0, "NO").otherwise("YES"))
    attributes = F.concat(_tag("ATTRIBUTE", NAME="Commit Interval", VALUE=k % 5 * 1000), F.when(k % 4 == 0, _tag("ATTRIBUTE", NAME="Pre SQL", VALUE=F.concat(F.lit("DELETE FROM T"), k))).otherwise(""))
    replaced = F.when(k % 11 == 0, "$Param").when(k % 7 == 0, F.concat(F.lit("OVR_"), k))
    part = _tag("SESSTRANSFORMATIONINST", F.concat(F.when(replaced.isNotNull(), _tag("ATTRIBUTE", NAME="Target Table Name", VALUE=replaced)).otherwise(""), _tag("CONNECTIONREFERENCE", CONNECTIONNAME=F.concat(F.lit("C"), k % 11), CONNECTIONSUBTYPE="Oracle")), TRANSFORMATIONNAME="TGT")
    name = F.concat(F.lit("s_m_"), k)
    session = _tag("SESSION", F.concat(attributes, part), NAME=name, MAPPINGNAME=F.concat(F.lit("m_"), k), CONFIGREFERENCE=F.concat(F.lit("cfg_"), k % 3))
    first = k % batch == 0
    link = _tag("WORKFLOWLINK", FROMTASK=F.when(first, "Start").otherwise(F.concat(F.lit("s_m_"), k - 1)), TOTASK=name, CONDITION=F.when(k % 3 == 0, "Status = SUCCEEDED"))
    made = rows.select(b.alias("b"), F.coalesce("defined", F.lit("")).alias("defined"), mapping.alias("m"), session.alias("s"), _tag("TASKINSTANCE", TASKNAME=name).alias("t"), link.alias("l"), *[F.when((k % batch >= 5 * i) & (k % batch < 5 * i + 5), _tag("TASKINSTANCE", TASKTYPE="Session", REFERENCETASKNAME=name)).alias(f"w{i}") for i in range(3)])
    batches = made.groupBy("b").agg(*[_joined(F.col(c)).alias(c) for c in ("defined", "m", "s", "t", "l", "w0", "w1", "w2")])
    scheduler = _tag("SCHEDULER", _tag("SCHEDULEINFO", SCHEDULETYPE="RunOnce", FREQUENCY=F.when(F.col("b") % 4 == 0, "Daily").otherwise("Weekly")), NAME=F.concat(F.lit("sch_"), F.col("b") % 4))
    configs = F.concat(*[_tag("CONFIG", _tag("ATTRIBUTE", NAME="Tracing", VALUE=str(i)), NAME=f"cfg_{i}") for i in range(3)])
    workflow = _tag("WORKFLOW", F.concat("t", "l"), NAME=F.concat(F.lit("wf_b"), "b"), SCHEDULERREFERENCE=F.concat(F.lit("sch_"), F.col("b") % 4))
    inside = _tag("FOLDER", F.concat("defined", _containers(F.col("b")), "m", "s", scheduler, configs, workflow), NAME=F.concat(F.lit("F"), F.col("b") % 7), OWNER="etl")
    files = batches.select(F.floor(F.col("b") / per_file).cast("long").alias("f"), inside.alias("xml")).groupBy("f").agg(_joined(F.col("xml")).alias("xml"))
    head = _tag("REPOSITORY", F.col("xml"), NAME=F.concat(F.lit("REP_"), F.col("f") % 3), VERSION="1", CODEPAGE="UTF-8", DATABASETYPE="Oracle")
    whole = F.concat(F.lit('<POWERMART CREATION_DATE="2020-01-01">'), head, F.lit("</POWERMART>"))
    files.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def read_folders(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each FOLDER element of any file; a broken one is kept in ``_corrupt_record``, later ones stay readable."""
    return spark.read.option("rowTag", "FOLDER").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(FOLDER).xml(folder)


def repository_meta(spark: SparkSession, folder: str) -> DataFrame:
    """name, version, codepage, database_type, files: repositories by their attributes."""
    rows = spark.read.option("rowTag", "REPOSITORY").schema(REPOSITORY).xml(folder)
    return rows.groupBy(F.col("_NAME").alias("name"), F.col("_VERSION").alias("version"), F.col("_CODEPAGE").alias("codepage"), F.col("_DATABASETYPE").alias("database_type")).agg(F.count("*").alias("files"))


def _each(folders: DataFrame, child: str) -> DataFrame:
    return folders.select(F.col("_NAME").alias("folder"), F.explode(child).alias("e"))


def _nested(rows: DataFrame, child: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(f"e.{child}").alias("i"))


def lookup_tables(folders: DataFrame) -> DataFrame:
    """folder, transform, tname: the table attribute, else the table after FROM in the override; no parameters, no short names."""
    rows = _each(folders, "TRANSFORMATION").where("e._TYPE = 'Lookup Procedure'").select("folder", F.col("e._NAME").alias("transform"), F.explode("e.TABLEATTRIBUTE").alias("a"))
    explicit = F.when(F.lower("a._NAME") == "lookup table name", F.upper(F.trim("a._VALUE")))
    queried = F.when(F.lower("a._NAME") == "lookup sql override", F.regexp_extract(F.upper("a._VALUE"), r"\bFROM\s+([A-Z0-9_.]+)", 1))
    named = rows.groupBy("folder", "transform").agg(F.coalesce(F.max(explicit), F.max(queried)).alias("tname"))
    return named.where((F.length("tname") > 2) & ~F.col("tname").startswith("$"))


def mapping_tables(folders: DataFrame) -> DataFrame:
    """mapping, sources, targets, lookups: table names by role, sorted."""
    rows = _nested(_each(folders, "MAPPING"), "INSTANCE", "folder", F.col("e._NAME").alias("mapping"))
    looked = lookup_tables(folders).select("folder", F.col("transform").alias("tx"), "tname").distinct()
    found = rows.select("folder", "mapping", F.col("i._TRANSFORMATION_TYPE").alias("kind"), F.col("i._TRANSFORMATION_NAME").alias("tx")).join(looked, ["folder", "tx"], "left")
    of = lambda kind, name: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, name))), ",")
    return found.groupBy("mapping").agg(of("Source Definition", F.col("tx")).alias("sources"), of("Target Definition", F.col("tx")).alias("targets"), of("Lookup Procedure", F.col("tname")).alias("lookups"))


def nested(nodes: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, root, node: what every node (keys, node) holds, itself included, through ``refs`` (keys, node, inner) of any depth. A
    pair is followed once, so containers that hold each other in a circle end."""
    refs = stored(refs.select(*keys, "node", "inner").distinct(), "nested-refs")
    seen = stored(nodes.select(*keys, F.col("node").alias("root"), "node").distinct(), "nested")
    front = seen
    while True:
        deeper = front.join(refs, [*keys, "node"]).select(*keys, "root", F.col("inner").alias("node")).distinct().join(seen, [*keys, "root", "node"], "left_anti")
        front = stored(deeper, "nested")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def worklet_sessions(folders: DataFrame) -> DataFrame:
    """worklet, session: sessions of a worklet and of those inside it, to any depth."""
    lets = _each(folders, "WORKLET").select("folder", F.col("e._NAME").alias("node"), F.explode_outer("e.TASKINSTANCE").alias("t"))
    tasks = stored(lets.select("folder", "node", F.lower("t._TASKTYPE").alias("kind"), F.col("t._REFERENCETASKNAME").alias("ref")), "worklets")
    held = nested(tasks, tasks.where("kind = 'worklet' and ref is not null").withColumnRenamed("ref", "inner"), ["folder"])
    own = tasks.where("kind = 'session' and ref is not null").select("folder", "node", F.col("ref").alias("session"))
    return held.join(own, ["folder", "node"]).select(F.col("root").alias("worklet"), "session").distinct()


def mapplet_tables(folders: DataFrame) -> DataFrame:
    """mapping, role, tname: the tables that a mapping uses through its mapplets, and through mapplets inside these.

    A mapplet's sources, their associated sources and targets are its instances'; a lookup's table is that of its own
    transformations first, then of the folder's.
    """
    rows = _each(folders, "MAPPLET").select("folder", F.upper(F.trim("e._NAME")).alias("node"), "e")
    inside = stored(rows.select("folder", "node", F.explode_outer("e.INSTANCE").alias("i")).select(
        "folder", "node", F.lower("i._TYPE").alias("type"), F.lower("i._TRANSFORMATION_TYPE").alias("kind"), F.coalesce("i._TRANSFORMATION_NAME", "i._NAME").alias("name"), F.transform("i.ASSOCIATED_SOURCE_INSTANCE", lambda a: a["_NAME"]).alias("also")), "mapplets")
    mine = rows.select("folder", "node", F.explode("e.TRANSFORMATION").alias("x")).select("folder", "node", F.col("x._NAME").alias("name"), F.explode("x.TABLEATTRIBUTE").alias("a")).where("lower(a._NAME) = 'lookup table name'")
    mine = mine.groupBy("folder", "node", "name").agg(F.upper(F.trim(F.max("a._VALUE"))).alias("own"))
    shared = lookup_tables(folders).groupBy("folder", F.col("transform").alias("name")).agg(F.min("tname").alias("common"))
    looked = inside.where("kind like '%lookup%'").join(mine, ["folder", "node", "name"], "left").join(shared, ["folder", "name"], "left").select("folder", "node", F.lit("lookup").alias("role"), F.coalesce("own", "common").alias("tname"))
    read = inside.where("type = 'source'").select("folder", "node", F.lit("source").alias("role"), F.explode(F.concat(F.array(F.upper("name")), F.coalesce(F.transform("also", F.upper), F.array().cast("array<string>")))).alias("tname"))
    written = inside.where("type = 'target'").select("folder", "node", F.lit("target").alias("role"), F.upper("name").alias("tname"))
    tables = stored(looked.unionByName(read).unionByName(written).where("tname is not null").distinct(), "mapplet-tables")
    refs = inside.where("type = 'mapplet'").select("folder", "node", F.upper(F.trim("name")).alias("inner"))
    held = nested(inside, refs, ["folder"])
    uses = _nested(_each(folders, "MAPPING"), "INSTANCE", "folder", F.col("e._NAME").alias("mapping")).where("lower(i._TYPE) = 'mapplet'").select("folder", "mapping", F.upper(F.trim(F.coalesce("i._TRANSFORMATION_NAME", "i._NAME"))).alias("root"))
    return uses.join(held, ["folder", "root"]).join(tables, ["folder", "node"]).select("mapping", "role", "tname").distinct()


def conditions(folders: DataFrame) -> DataFrame:
    """mapping, transform, kind, text, extra: SQL in place of a read, conditions of joins (extra: their type), filters, lookups (extra:
    the table) and router groups (extra: the group). Reusable transformations have no mapping; empty values are left out."""
    own = _nested(_each(folders, "MAPPING"), "TRANSFORMATION", F.col("e._NAME").alias("mapping")).select("mapping", F.col("i").alias("x"))
    rows = own.unionByName(_each(folders, "TRANSFORMATION").select(F.lit(None).cast("string").alias("mapping"), F.col("e").alias("x")))
    value = lambda part: F.try_element_at(F.filter("x.TABLEATTRIBUTE", lambda a: F.contains(F.lower(a["_NAME"]), F.lit(part))), F.lit(1))["_VALUE"]
    at = rows.select("mapping", F.col("x._NAME").alias("transform"), F.lower("x._TYPE").alias("type"), value("join type").alias("join"), value("lookup table name").alias("table"), F.explode("x.TABLEATTRIBUTE").alias("a"))
    name, has = F.lower("a._NAME"), lambda s: F.contains(F.lower("a._NAME"), F.lit(s))
    kind = F.when(has("sql query") | has("sql override"), "sql").when(has("join condition"), "join").when((name == "filter condition") & F.contains("type", F.lit("filter")), "filter").when(has("lookup condition"), "lookup")
    extra = F.when(kind == "join", F.col("join")).when(kind == "lookup", F.col("table"))
    found = at.select("mapping", "transform", kind.alias("kind"), F.trim("a._VALUE").alias("text"), F.coalesce(extra, F.lit("")).alias("extra")).where("kind is not null and text <> ''")
    routed = rows.where("lower(x._TYPE) like '%router%'").select("mapping", F.col("x._NAME").alias("transform"), F.explode("x.GROUP").alias("g")).where("g._NAME is not null")
    return found.unionByName(routed.select("mapping", "transform", F.lit("router").alias("kind"), F.coalesce("g._EXPRESSION", F.lit("")).alias("text"), F.col("g._NAME").alias("extra")))


def connectors(folders: DataFrame) -> DataFrame:
    """mapping, from_instance, from_field, to_instance, to_field."""
    rows = _nested(_each(folders, "MAPPING"), "CONNECTOR", F.col("e._NAME").alias("mapping"))
    return rows.select("mapping", *[F.col(f"i._{a}").alias(b) for a, b in (("FROMINSTANCE", "from_instance"), ("FROMFIELD", "from_field"), ("TOINSTANCE", "to_instance"), ("TOFIELD", "to_field"))])


def mapping_catalog(folders: DataFrame) -> DataFrame:
    """mapping, folder, valid, instances, connectors, sessions."""
    rows = _each(folders, "MAPPING").select("folder", F.col("e._NAME").alias("mapping"), (F.col("e._ISVALID") == "YES").alias("valid"), F.coalesce(F.size("e.INSTANCE"), F.lit(0)).alias("instances"), F.coalesce(F.size("e.CONNECTOR"), F.lit(0)).alias("connectors"))
    used = _each(folders, "SESSION").groupBy("folder", F.col("e._MAPPINGNAME").alias("mapping")).agg(F.array_join(F.sort_array(F.collect_set("e._NAME")), ",").alias("sessions"))
    size = lambda c: F.greatest(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(used, ["folder", "mapping"], "left").select("mapping", "folder", "valid", size("instances"), size("connectors"), F.coalesce("sessions", F.lit("")).alias("sessions"))


def session_attributes(folders: DataFrame) -> DataFrame:
    """session, name, value, connections: attributes of a session and the connections that it uses."""
    rows = _each(folders, "SESSION")
    used = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("e.SESSTRANSFORMATIONINST", lambda x: F.transform(x["CONNECTIONREFERENCE"], lambda r: r["_CONNECTIONNAME"]))))), ",")
    return rows.select(F.col("e._NAME").alias("session"), used.alias("connections"), F.explode("e.ATTRIBUTE").alias("a")).select("session", F.col("a._NAME").alias("name"), F.col("a._VALUE").alias("value"), "connections")


def session_overrides(folders: DataFrame) -> DataFrame:
    """session, role, tname: tables that a session puts in place of its mapping's; parameters are left out."""
    rows = _nested(_each(folders, "SESSION"), "SESSTRANSFORMATIONINST", F.col("e._NAME").alias("session")).select("session", F.explode("i.ATTRIBUTE").alias("a"))
    kind = F.lower("a._NAME")
    role = F.when(F.contains(kind, F.lit("target table")), "target").when(F.contains(kind, F.lit("source table")), "source").when(F.contains(kind, F.lit("lookup table")), "lookup")
    return rows.select("session", role.alias("role"), F.upper("a._VALUE").alias("tname")).where("role is not null and tname not like '$%'").distinct()


def pre_post_sql(folders: DataFrame) -> DataFrame:
    """session, kind, sql of the statements before and after a session."""
    kind = F.regexp_extract(F.lower("name"), r"^(pre|post) sql$", 1)
    return session_attributes(folders).select("session", kind.alias("kind"), F.col("value").alias("sql")).where("kind <> ''")


def workflow_edges(folders: DataFrame) -> DataFrame:
    """workflow, from_task, to_task, condition: links, once for each pair of tasks."""
    rows = _nested(_each(folders, "WORKFLOW"), "WORKFLOWLINK", F.col("e._NAME").alias("workflow"))
    return rows.groupBy("workflow", F.col("i._FROMTASK").alias("from_task"), F.col("i._TOTASK").alias("to_task")).agg(F.coalesce(F.max("i._CONDITION"), F.lit("")).alias("condition"))


def workflow_order(edges: DataFrame, tiers) -> DataFrame:
    """workflow, task, step: longest path from the start, then by name; ``tiers``: the longest-path operator (sid, tier)."""
    key = lambda c: F.concat_ws("\x01", "workflow", c)
    named = edges.select(key("from_task").alias("src"), key("to_task").alias("dst"))
    nodes = named.select(F.col("src").alias("sid")).union(named.select("dst")).distinct()
    found = tiers(nodes, named).select(F.substring_index("sid", "\x01", 1).alias("workflow"), F.substring_index("sid", "\x01", -1).alias("task"), "tier").where("task <> 'Start'")
    return found.select("workflow", "task", F.row_number().over(Window.partitionBy("workflow").orderBy("tier", "task")).cast("long").alias("step"))


def config_usage(folders: DataFrame) -> DataFrame:
    """config, attributes, sessions: configs with the number of sessions that use them."""
    made = _each(folders, "CONFIG").select("folder", F.col("e._NAME").alias("config"), F.array_join(F.transform("e.ATTRIBUTE", lambda a: F.concat_ws("=", a["_NAME"], a["_VALUE"])), ",").alias("attributes")).distinct()
    used = _each(folders, "SESSION").groupBy("folder", F.col("e._CONFIGREFERENCE").alias("config")).agg(F.count("*").alias("n"))
    return made.join(used, ["folder", "config"], "left").groupBy("config", "attributes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"))


def schedules(folders: DataFrame) -> DataFrame:
    """session, scheduler, frequency: a workflow's schedule holds for its sessions."""
    times = _each(folders, "SCHEDULER").select("folder", F.col("e._NAME").alias("scheduler"), F.element_at("e.SCHEDULEINFO", 1)["_FREQUENCY"].alias("frequency")).distinct()
    tasks = _each(folders, "WORKFLOW").select("folder", F.col("e._SCHEDULERREFERENCE").alias("scheduler"), F.explode("e.TASKINSTANCE").alias("t")).select("folder", "scheduler", F.col("t._TASKNAME").alias("session"))
    return tasks.join(times, ["folder", "scheduler"], "left").select("session", "scheduler", "frequency")


def connection_profiles(folders: DataFrame) -> DataFrame:
    """connection, subtype, sessions: connections once (in any case) and how many sessions use each."""
    rows = _nested(_each(folders, "SESSION"), "SESSTRANSFORMATIONINST", F.col("e._NAME").alias("session")).select("session", F.explode("i.CONNECTIONREFERENCE").alias("c"))
    return rows.groupBy(F.upper("c._CONNECTIONNAME").alias("connection")).agg(F.min("c._CONNECTIONSUBTYPE").alias("subtype"), F.countDistinct("session").alias("sessions"))


def definitions(folders: DataFrame) -> DataFrame:
    """kind, name, database, fields: source and target definitions, once by name, with their fields."""
    out = None
    for kind, child, field in (("source", "SOURCE", "SOURCEFIELD"), ("target", "TARGET", "TARGETFIELD")):
        fields = F.array_join(F.transform(f"e.{field}", lambda x: F.concat_ws(":", x["_NAME"], x["_DATATYPE"], x["_KEYTYPE"])), ",")
        part = _each(folders, child).select(F.lit(kind).alias("kind"), F.col("e._NAME").alias("name"), F.col("e._DATABASETYPE").alias("database"), fields.alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "name").agg(F.min("database").alias("database"), F.min("fields").alias("fields"))


def ingest_audit(spark: SparkSession, folder: str) -> DataFrame:
    """status, folders, sessions: what was read, by whether the record was whole, and in all."""
    status = F.when(F.col("_corrupt_record").isNull(), "ok").otherwise("broken")
    rows = read_folders(spark, folder).select(status.alias("status"), F.greatest(F.coalesce(F.size("SESSION"), F.lit(0)), F.lit(0)).alias("n"))
    return rows.rollup("status").agg(F.count("*").alias("folders"), F.sum("n").alias("sessions")).select(F.coalesce("status", F.lit("all")).alias("status"), "folders", "sessions")


def classify_platform(spark: SparkSession, folder: str) -> DataFrame:
    """file, platform by the first 5,000 characters of each file."""
    files = spark.read.text(folder, wholetext=True).select(F.lower(F.substring("value", 1, 5000)).alias("head"), F.col("_metadata.file_name").alias("file"))
    has = lambda s: F.contains("head", F.lit(s))
    # fixed values: what marks an export of mappings
    mapped = has("informatica") | has("<folder ") | has("<mapping ") | (has("<session ") & has("<workflow "))
    return files.select("file", F.when(mapped, "mapping").otherwise("flow").alias("platform"))
