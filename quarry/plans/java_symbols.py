"""Names of Java sources resolved by scope, imports and packages, and the metrics that need them.

A type name is looked up, in this order, as a member of the enclosing classes, by the file's imports of single
types, in its package, by its wildcard imports, as it stands, and among the types of ``java.lang``. A chain of
field accesses and calls is followed step by step: a member is looked up in the class and its superclasses
and interfaces, the nearest first, and its declared type is where the next step starts. All of this is done by
joins over distinct names and distinct chains.

Of types outside the project those of the platform (``java.``, ``javax.``) are known by name: a call or field of
theirs counts as declared by the type it is used on, and what it gives isn't known. All other types outside the
project are unresolved; ``coverage`` says which share is resolved. What that leaves out is missing in the counts, and
LAA and FDP are undefined where a field access can't be resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import graph

CLASS = ["path", "package", "class"]
METHOD = [*CLASS, "member"]
CHAIN = [*CLASS, "origin", "steps"]
#: Public types of java.lang.
JAVA_LANG = """Appendable AutoCloseable CharSequence Cloneable Comparable Iterable Readable Runnable Boolean Byte Character Class ClassLoader ClassValue
Double Enum Float InheritableThreadLocal Integer Long Math Module ModuleLayer Number Object Package Process ProcessBuilder ProcessHandle Record Runtime
RuntimePermission SecurityManager Short StackTraceElement StackWalker StrictMath String StringBuffer StringBuilder System Thread ThreadGroup ThreadLocal
Throwable Void ArithmeticException ArrayIndexOutOfBoundsException ArrayStoreException ClassCastException ClassNotFoundException CloneNotSupportedException
EnumConstantNotPresentException Exception IllegalAccessException IllegalArgumentException IllegalCallerException IllegalMonitorStateException
IllegalStateException IllegalThreadStateException IndexOutOfBoundsException InstantiationException InterruptedException LayerInstantiationException
NegativeArraySizeException NoSuchFieldException NoSuchMethodException NullPointerException NumberFormatException ReflectiveOperationException
RuntimeException SecurityException StringIndexOutOfBoundsException TypeNotPresentException UnsupportedOperationException AbstractMethodError
AssertionError BootstrapMethodError ClassCircularityError ClassFormatError Error ExceptionInInitializerError IllegalAccessError
IncompatibleClassChangeError InstantiationError InternalError LinkageError NoClassDefFoundError NoSuchFieldError NoSuchMethodError OutOfMemoryError
StackOverflowError ThreadDeath UnknownError UnsatisfiedLinkError UnsupportedClassVersionError VerifyError VirtualMachineError Deprecated
FunctionalInterface Override SafeVarargs SuppressWarnings""".split()


#: Depths of some classes of java.lang, instance methods of Object, methods that say nothing about a class, and types taken for known by the name a call is made on.
PLATFORM_DEPTH = {"Math": 1, "StrictMath": 1, "String": 1, "System": 1, "Character": 1, "Boolean": 1, "Thread": 1, "Runtime": 1, "Integer": 2, "Long": 2, "Double": 2, "Float": 2, "Short": 2, "Byte": 2}
OBJECT = ("getClass()", "hashCode()", "equals(Object)", "clone()", "toString()", "notify()", "notifyAll()", "wait()", "wait(long)", "wait(long, int)", "finalize()")
BOILERPLATE = ("toString", "equals", "hashCode", "finalize", "clone", "readObject", "writeObject")
INFERRED = ("java.util.Objects", "java.util.Comparator", "java.util.Collections", "java.util.Arrays", "java.lang.String", "java.lang.Math", "java.lang.System", "java.util.Optional", "java.util.stream.Stream")


def _bare(type_: Column) -> Column:
    """A type's name without type arguments and dimensions."""
    return F.regexp_replace(type_, r"(<.*>)|(\[\])|(\.\.\.)|\s", "")


def _dims(type_: Column) -> Column:
    return F.regexp_count(F.regexp_replace(type_, "<.*>", ""), F.lit(r"\[\]")).cast("int")


def platform(name: Column) -> Column:
    return name.startswith("java.") | name.startswith("javax.")


def enclosing(class_: Column, package: Column) -> Column:
    """The class and the classes around it, innermost first."""
    parts = F.split(class_, r"\.")
    outer = F.when(package == "", 0).otherwise(F.size(F.split(package, r"\.")))
    return F.transform(F.sequence(F.size(parts), F.least(outer + 1, F.size(parts)), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def project_types(t: dict[str, DataFrame]) -> DataFrame:
    """(type, package, kind) of all types that the project declares."""
    return t["classes"].select(F.col("class").alias("type"), "package", F.col("class_kind").alias("kind")).unionByName(t["unsupported"].select(F.col("class").alias("type"), "package", "kind")).dropDuplicates(["type"])


def type_targets(names: DataFrame, t: dict[str, DataFrame], types: DataFrame) -> DataFrame:
    """``names`` (path, package, class, name), distinct, with target (qualified) and inside (whether in the project); target null if unknown."""
    imports = t["imports"].filter(~F.array_contains("modifiers", "static"))
    single = imports.filter("op is null or op != '*'").select("path", F.element_at(F.split("name", r"\."), -1).alias("last"), "name").groupBy("path", "last").agg(F.min("name").alias("imported"))
    wild = imports.filter("op = '*'").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("wild"))
    first = F.substring_index("name", ".", 1)
    rest = F.substring(F.col("name"), F.length(first) + 1, F.lit(1 << 30))
    joined = names.select(*CLASS, "name", first.alias("last"), rest.alias("rest")).join(single, ["path", "last"], "left").join(wild, "path", "left")
    below = lambda scope: F.concat(scope, F.lit("."), F.col("name"))
    imported = F.concat("imported", "rest")
    candidates = F.concat(
        F.transform(enclosing(F.col("class"), F.col("package")), below), F.array(imported), F.array(F.when(F.col("package") == "", F.col("name")).otherwise(below(F.col("package")))),
        F.transform(F.coalesce("wild", F.array()), below), F.array(F.col("name")),
    )
    tried = joined.select(*CLASS, "name", F.posexplode(candidates).alias("rank", "type")).join(types.select("type"), "type")
    found = tried.groupBy(*CLASS, "name").agg(F.min_by("type", "rank").alias("found"))
    qualified = F.col("name").rlike(r"^[a-z_][\w$]*\..*\b[A-Z]")
    outside = F.coalesce(F.when(platform(imported), imported), F.when(F.col("name").isin(*JAVA_LANG), F.concat(F.lit("java.lang."), "name")), F.when(qualified & platform(F.col("name")), F.col("name")))
    return joined.join(found, [*CLASS, "name"], "left").select(*CLASS, "name", F.coalesce("found", outside).alias("target"), F.col("found").isNotNull().alias("inside"))


def supertypes(t: dict[str, DataFrame], types: DataFrame) -> DataFrame:
    """(path, package, class, class_kind, kind, name, target, inside): extends and implements clauses; target null where unknown."""
    named = lambda column, kind: t["classes"].select(*CLASS, "class_kind", F.explode(column).alias("name"), F.lit(kind).alias("kind"))
    clauses = named("extends_types", "extends").unionByName(named("implements_types", "implements"))
    return clauses.join(type_targets(clauses.select(*CLASS, "name").distinct(), t, types), [*CLASS, "name"])


def members(t: dict[str, DataFrame]) -> DataFrame:
    """(path, package, class, mkind f or c, name, arity, type, is_static, is_private) of fields and methods."""
    keys = [*METHOD, F.array_contains("modifiers", "static").alias("is_static"), F.array_contains("modifiers", "private").alias("is_private"), (F.col("class_kind") == "interface").alias("constant")]
    fields = t["nodes"].filter("member_kind = 'field' and kind = 'variable'").select(*METHOD, "name", "type").join(t["members"].filter("member_kind = 'field'").select(*keys), METHOD)
    fields = fields.select(*CLASS, F.lit("f").alias("mkind"), "name", F.lit(-1).cast("long").alias("arity"), "type", (F.col("is_static") | F.col("constant")).alias("is_static"), "is_private")
    methods = t["members"].filter("member_kind = 'method'").select(*keys, "name", F.col("params").alias("arity"), "type")
    return fields.unionByName(methods.select(*CLASS, F.lit("c").alias("mkind"), "name", "arity", "type", "is_static", "is_private")).dropDuplicates(["class", "mkind", "name", "arity"])


def symbols(t: dict[str, DataFrame], types: DataFrame, lines: DataFrame) -> DataFrame:
    """(owner, mkind, name, arity, declaring, is_static, type, next, dims): every class's own and inherited members, the nearest of each name."""
    own = members(t)
    named = own.select(*CLASS, _bare(F.col("type")).alias("name")).distinct()
    targets = type_targets(named, t, types).select(*CLASS, F.col("name").alias("bare"), F.when(F.col("inside"), F.col("target")).alias("next"))
    typed = graph.kept(own.withColumn("bare", _bare(F.col("type"))).join(targets, [*CLASS, "bare"], "left").select("class", "mkind", "name", "arity", "type", "is_static", "is_private", "next", _dims(F.col("type")).alias("dims")))
    mine = typed.withColumn("owner", F.col("class")).withColumn("distance", F.lit(0).cast("long"))
    above = lines.select(F.col("src").alias("owner"), F.col("dst").alias("class"), "distance").join(typed.filter("not is_private"), "class").select(*mine.columns)
    nearest = Window.partitionBy("owner", "mkind", "name", "arity").orderBy("distance", "class")
    every = mine.unionByName(above).withColumn("nth", F.row_number().over(nearest)).filter("nth = 1")
    return every.select("owner", "mkind", "name", "arity", F.col("class").alias("declaring"), "is_static", "type", "next", "dims")


def resolved_chains(t: dict[str, DataFrame], types: DataFrame, lines: DataFrame, clauses: DataFrame) -> DataFrame:
    """(path, package, class, origin, steps) of all chains, with the last step's declaring class, is_static, type and arity; ``value`` is false for names of types, ``names_type`` then being which."""
    known = graph.kept(symbols(t, types, lines))
    chains = t["accesses"].select(*CHAIN).distinct()
    origin = F.col("origin")
    named = origin.startswith("type:")
    start = chains.withColumn("bare", F.when(named, _bare(F.substring(origin, 6, 1 << 30)))).withColumn("dims", F.when(named, _dims(F.substring(origin, 6, 1 << 30))).otherwise(0))
    own_types = type_targets(start.filter("bare is not null and bare not in ('?', '')").select(*CLASS, F.col("bare").alias("name")).distinct(), t, types)
    start = start.join(own_types.select(*CLASS, F.col("name").alias("bare"), F.col("target").alias("at")), [*CLASS, "bare"], "left")
    parent = clauses.filter("kind = 'extends'").groupBy(*CLASS).agg(F.min("target").alias("parent"))
    start = start.join(parent, CLASS, "left").withColumn("at", F.when(origin == "this", F.col("class")).when(origin == "super", F.col("parent")).otherwise(F.col("at")))
    kind = lambda k: F.substring(F.element_at("steps", k), 1, 1)
    text = lambda k: F.substring(F.element_at("steps", k), 3, 1 << 30)
    name = lambda k: F.when(kind(k) == "c", F.substring_index(text(k), "/", 1)).otherwise(text(k))
    arity = lambda k: F.when(kind(k) == "c", F.substring_index(text(k), "/", -1).cast("long")).otherwise(F.lit(-1).cast("long"))
    # a name without a qualifier: a member of the classes around it, innermost first, or else a type
    free = start.filter(origin == "scope").select(*CHAIN, kind(1).alias("mkind"), name(1).alias("name"), arity(1).alias("arity"))
    owners = free.select(*CLASS, "mkind", "name", "arity").distinct().select("*", F.posexplode(enclosing(F.col("class"), F.col("package"))).alias("rank", "owner"))
    nearest = owners.join(known, ["owner", "mkind", "name", "arity"]).groupBy(*CLASS, "mkind", "name", "arity").agg(F.min_by(F.struct("declaring", "is_static", "type", "next", "dims"), "rank").alias("m"))
    as_type = type_targets(free.filter("mkind = 'f'").select(*CLASS, "name").distinct(), t, types).select(*CLASS, "name", "target", F.col("target").isNotNull().alias("is_type"))
    free = free.join(nearest, [*CLASS, "mkind", "name", "arity"], "left").join(as_type, [*CLASS, "name"], "left")
    first = free.select(*CHAIN, "m.declaring", "m.is_static", F.col("m.type").alias("type"), F.when(F.col("m").isNotNull(), F.col("m.next")).otherwise(F.col("target")).alias("at"), F.coalesce(F.col("m.dims"), F.lit(0)).alias("dims"), (F.col("m").isNotNull() | ~F.coalesce("is_type", F.lit(False))).alias("value"), F.lit(1).alias("k"))
    empty = {"declaring": "string", "is_static": "boolean", "type": "string"}
    begun = start.filter(origin != "scope").select(*CHAIN, *(F.lit(None).cast(c).alias(n) for n, c in empty.items()), "at", "dims", F.lit(True).alias("value"), F.lit(0).alias("k"))
    state = graph.kept(first.unionByName(begun))
    done = [state.filter(F.size("steps") == F.col("k"))]
    most = state.agg(F.max(F.size("steps"))).first()[0] or 0
    nowhere = [F.lit(None).cast(c).alias(n) for n, c in empty.items()]
    for _ in range(most):  # at most as many joins as the longest chain has steps; what isn't known ends there
        rest = state.filter(F.size("steps") > F.col("k"))
        done.append(rest.filter("at is null").select(*CHAIN, *nowhere, "at", "dims", F.lit(True).alias("value"), "k"))
        state = rest.filter("at is not null").withColumn("k", F.col("k") + 1)
        if state.isEmpty():
            break
        on = [F.col("at") == F.col("owner"), F.col("skind") == F.col("mkind"), F.col("sname") == F.col("mname"), F.col("sarity") == F.col("marity"), F.col("dims") == 0]
        asked = state.select(*CHAIN, "k", "at", "dims", kind(F.col("k")).alias("skind"), name(F.col("k")).alias("sname"), arity(F.col("k")).alias("sarity"))
        there = known.select("owner", "mkind", F.col("name").alias("mname"), F.col("arity").alias("marity"), "declaring", "is_static", "type", "next", F.col("dims").alias("mdims"))
        joined = asked.join(there, on, "left")
        index = F.col("skind") == "i"
        made, abroad = F.col("skind") == "n", platform(F.col("at")) & F.col("skind").isin("c", "f") & (F.col("dims") == 0)
        declaring = F.coalesce("declaring", F.when(made | abroad, F.col("at"))).alias("declaring")
        is_static = F.coalesce("is_static", abroad & (F.col("skind") == "f")).alias("is_static")
        state = graph.kept(joined.select(*CHAIN, declaring, is_static, "type", F.when(index & (F.col("dims") > 0), F.col("at")).otherwise(F.col("next")).alias("at"), F.when(index, F.col("dims") - 1).otherwise(F.coalesce("mdims", F.lit(0))).alias("dims"), F.lit(True).alias("value"), "k"))
        done.append(state.filter(F.size("steps") == F.col("k")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*CHAIN, "declaring", "is_static", "type", "value", F.when(~F.col("value"), F.col("at")).alias("names_type"), name(F.size("steps")).alias("last"), arity(F.size("steps")).alias("arity"))


def visibility(modifiers: Column, owner: Column, interface: Column) -> Column:
    """How far a member is seen, its owner's own visibility considered."""
    has = F.array_contains
    return (
        F.when(has(modifiers, "private") | has(owner, "private"), "private").when(has(modifiers, "protected") | has(owner, "protected"), "protected")
        .when((has(modifiers, "public") | interface) & has(owner, "public"), "public").otherwise("package")
    )


class Symbols:
    """Everything resolved once, as stored tables."""

    def __init__(self, t: dict[str, DataFrame]):
        self.t = t
        self.types = graph.kept(project_types(t))
        self.clauses = graph.kept(supertypes(t, self.types))
        edges = self.clauses.filter("target is not null").select(F.col("class").alias("src"), F.col("target").alias("dst")).filter("src != dst")
        self.lines = graph.levels(edges)  # external types are leaves
        self.chains = graph.kept(resolved_chains(t, self.types, self.lines.join(self.types.select(F.col("type").alias("dst")), "dst", "left_semi"), self.clauses))
        self.accesses = graph.kept(t["accesses"].select(*METHOD, "member_kind", "kind", "name", "origin", "steps").join(self.chains, CHAIN))

    def coverage(self) -> DataFrame:
        """attempts, resolved and coverage of accesses and supertypes; coverage is null without any."""
        counted = self.accesses.filter("value and kind in ('name', 'field', 'call')").agg(F.count("*").alias("a"), F.count("declaring").alias("r")).crossJoin(F.broadcast(self.clauses.agg(F.count("*").alias("c"), F.count("target").alias("s"))))
        return counted.select((F.col("a") + F.col("c")).alias("attempts"), (F.col("r") + F.col("s")).alias("resolved"), F.try_divide((F.col("r") + F.col("s")).cast("double"), F.col("a") + F.col("c")).alias("coverage"))

    def superclasses(self) -> DataFrame:
        """(class, ancestor) along superclasses inside the project: only a class can extend a class."""
        kinds = self.types.filter("kind = 'class'").select(F.col("type").alias("ancestor"))
        return self.lines.select(F.col("src").alias("class"), F.col("dst").alias("ancestor")).join(kinds, "ancestor", "left_semi").select("class", "ancestor")

    def inheritance(self) -> DataFrame:
        """(class, DIT, NOC): depth along superclasses, an external one counting one level and an unknown one none; direct extensions."""
        classes = self.t["classes"].select("class").dropDuplicates(["class"])
        extends = self.clauses.filter("kind = 'extends' and target is not null").select("class", "target", "class_kind", "inside").distinct()
        abroad = extends.filter("class_kind = 'class' and not inside").select("class").distinct()
        above = self.superclasses()
        ends = above.join(abroad.withColumnRenamed("class", "ancestor"), "ancestor", "left_semi").select("class").unionByName(abroad).distinct().withColumn("abroad", F.lit(1))
        children = extends.groupBy(F.col("target").alias("class")).agg(F.count("*").alias("NOC"))
        out = classes.join(above.groupBy("class").agg(F.count("*").alias("above")), "class", "left").join(ends, "class", "left").join(children, "class", "left").na.fill(0, ["above", "abroad", "NOC"])
        return out.select("class", (1 + F.col("above") + F.col("abroad")).alias("DIT"), "NOC")

    def _with_outer(self, rows: DataFrame) -> DataFrame:
        """Rows of a class under the classes around it too, as those hold its text."""
        return rows.withColumn("class", F.explode(enclosing(F.col("class"), F.col("package"))))

    def class_metrics(self) -> DataFrame:
        """Per class: ATFD, LAA and FDP (null where undefined)."""
        a = self.accesses
        field = F.col("kind").isin("field", "name") & (F.element_at("steps", -1).startswith("f:"))
        returns = F.col("type")
        accessor = (F.col("kind") == "call") & (
            (F.col("last").startswith("get") & (F.col("arity") == 0) & (returns != "void")) | (F.col("last").startswith("is") & (F.col("arity") == 0) & (returns == "boolean")) | (F.col("last").startswith("set") & (F.col("arity") == 1) & (returns == "void"))
        )
        foreign = self._with_outer(a.filter((field | accessor) & F.col("declaring").isNotNull() & ~F.col("is_static")).select("package", "class", "declaring").distinct()).distinct()
        related = self.lines.select(F.col("src").alias("class"), F.col("dst").alias("declaring"))
        atfd = foreign.filter("class != declaring").join(related, ["class", "declaring"], "left_anti").groupBy("class").agg(F.count("*").alias("ATFD"))

        touched = a.filter("kind = 'field'").withColumn("known", F.col("declaring").isNotNull())
        per_member = touched.filter("member_kind != 'field'").groupBy(*METHOD).agg(F.bool_or(F.col("declaring") != F.col("class")).alias("abroad"), F.bool_and("known").alias("known"))
        local = self.t["members"].filter("member_kind != 'field'").select(*METHOD).join(per_member, METHOD, "left").groupBy("class").agg(
            F.bool_and(F.coalesce("known", F.lit(True))).alias("known"), (F.count_if(~F.coalesce("abroad", F.lit(False))) / F.count("*")).alias("share")
        )
        laa = local.select("class", F.when(F.col("known"), F.col("share")).alias("LAA"), F.lit(True).alias("has_members"))

        owners = self._with_outer(touched.select("package", "class", "declaring", "known").distinct()).distinct()
        readers = owners.filter("declaring is not null and class != declaring").groupBy(F.col("declaring").alias("class")).agg(F.count_distinct("class").alias("readers"))
        broken = owners.filter("not known").select("class").distinct()
        count = broken.agg(F.count("*").alias("broken"))  # one row
        out = self.t["classes"].select("class").distinct().join(atfd, "class", "left").join(laa, "class", "left").join(readers, "class", "left").join(broken.withColumn("mine", F.lit(1)), "class", "left").crossJoin(F.broadcast(count))
        poisoned = F.col("broken") > F.coalesce("mine", F.lit(0))
        return out.select("class", F.coalesce("ATFD", F.lit(0)).alias("ATFD"), F.when(F.col("has_members").isNull(), 1.0).otherwise(F.col("LAA")).alias("LAA"), F.when(~poisoned, F.coalesce("readers", F.lit(0))).alias("FDP"))

    def method_metrics(self) -> DataFrame:
        """Per method: CDISP, the number of different depths of the classes that declare what it calls."""
        kinds = self.types.select(F.col("type").alias("dst"), F.col("kind"))
        above = self.lines.join(kinds, "dst", "left")
        extended = self.clauses.filter("kind = 'extends'").select(F.col("class").alias("src"), F.col("target").alias("dst"), F.lit(True).alias("extended")).distinct()
        classes_above = above.join(extended, ["src", "dst"], "left").filter("kind = 'class' or (kind is null and extended and dst != 'java.lang.Object')").groupBy("src").agg(F.count("*").alias("above"))
        depth = self.types.filter("kind = 'class'").select(F.col("type").alias("declaring")).join(classes_above.withColumnRenamed("src", "declaring"), "declaring", "left").select("declaring", (1 + F.coalesce("above", F.lit(0))).alias("depth"))
        depth = depth.unionByName(self.t["classes"].sparkSession.createDataFrame([(f"java.lang.{n}", d) for n, d in PLATFORM_DEPTH.items()], "declaring string, depth long"))
        called = self.accesses.filter("kind = 'call' and member_kind = 'method' and declaring is not null").select(*METHOD, "declaring").distinct().join(depth, "declaring")
        return called.groupBy(*METHOD).agg(F.count_distinct("depth").alias("CDISP"))

    def couplings(self) -> DataFrame:
        """(class, dst): other types that a class depends on, named or reached by calls and fields, known ones outside the project too."""
        named = self.t["types"].select(*CLASS, "name").distinct()
        targets = type_targets(named, self.t, self.types).filter("target is not null").select("package", "class", F.col("target").alias("dst"))
        reached = self.accesses.filter("declaring is not null and kind in ('call', 'field')").select("package", "class", F.col("declaring").alias("dst"))
        edges = self._with_outer(targets.unionByName(reached).distinct()).select("class", "dst").distinct().filter("class != dst")
        return edges

    def foreign_couplings(self) -> DataFrame:
        """``couplings`` without ancestors."""
        return self.couplings().join(self.lines.select(F.col("src").alias("class"), "dst"), ["class", "dst"], "left_anti")

    def package_edges(self) -> DataFrame:
        """(src, dst) between packages: where the types come from that a package's classes depend on."""
        inside = self.types.select(F.col("type").alias("dst"), F.col("package").alias("known"))
        own = self.t["classes"].select("class", F.col("package").alias("src")).dropDuplicates(["class"])
        outside = F.regexp_extract("dst", r"^((?:[a-z_][\w$]*\.)*[a-z_][\w$]*)\.[A-Z]", 1)
        found = self.couplings().join(own, "class").join(inside, "dst", "left").select("src", F.coalesce("known", outside).alias("dst"))
        return found.filter("dst != '' and src != dst").distinct()

    def sizes(self) -> DataFrame:
        """(class, SIZE2): instance fields of the class and its direct supertypes, and all its instance methods, those of Object too.

        A class with a supertype that isn't resolved, by itself or further up, counts what it declares.
        """
        kinds = self.t["classes"].select("class", "class_kind").dropDuplicates(["class"])
        fields = members(self.t).filter("mkind = 'f' and not is_static").groupBy("class").agg(F.count("*").alias("fields"))
        direct = self.clauses.filter("inside").select("class", "target").distinct().join(fields.select(F.col("class").alias("target"), "fields"), "target").groupBy("class").agg(F.sum("fields").alias("more_fields"))
        methods = self.t["members"].filter((F.col("member_kind") == "method") & ~F.array_contains("modifiers", "static")).select("class", "member").distinct()
        above = self.lines.select(F.col("src").alias("class"), F.col("dst").alias("ancestor")).join(methods.select(F.col("class").alias("ancestor"), "member"), "ancestor").select("class", "member")
        objects = kinds.filter("class_kind = 'class'").select("class", F.explode(F.array(*map(F.lit, OBJECT))).alias("member"))
        own = methods.groupBy("class").agg(F.count("*").alias("own_methods"))
        every = methods.unionByName(above).unionByName(objects).distinct().groupBy("class").agg(F.count("*").alias("methods"))
        open_ = self.clauses.filter("target is null").select("class").distinct()
        broken = open_.unionByName(self.lines.join(open_.withColumnRenamed("class", "dst"), "dst").select(F.col("src").alias("class"))).distinct().withColumn("broken", F.lit(True))
        out = kinds.select("class")
        for part in (fields, direct, own, every, broken):
            out = out.join(part, "class", "left")
        out = out.na.fill(0, ["fields", "more_fields", "own_methods", "methods"])
        return out.select("class", F.when(F.col("broken"), F.col("fields") + F.col("own_methods")).otherwise(F.col("fields") + F.col("more_fields") + F.col("methods")).alias("SIZE2"))

    def coupling_metrics(self) -> DataFrame:
        """Per class: CBO, RFC (null for interfaces), MPC, DAC and WOC."""
        t, a = self.t, self.accesses
        imported = t["imports"].filter("op is null or op != '*'").select("path", F.col("name").alias("dst")).join(t["classes"].select("path", "class"), "path").select("class", "dst")
        marks = t["members"].select(*CLASS, F.explode("annotations").alias("name")).unionByName(t["classes"].select(*CLASS, F.explode("annotations").alias("name"))).distinct()
        named = t["types"].select(*CLASS, "name").unionByName(marks).distinct()
        targets = type_targets(named, t, self.types).filter("target is not null").select("package", "class", F.col("target").alias("dst"))
        called = a.filter("kind = 'call' and declaring is not null").select("package", "class", F.col("declaring").alias("dst"))
        scope = F.when((F.col("origin") == "scope") & (F.size("steps") == 2), F.substring(F.element_at("steps", 1), 3, 1 << 30))
        inferred = a.filter("kind = 'call' and declaring is null").select("package", "class", scope.alias("name")).filter("name is not null")
        guessed = F.create_map(*(F.lit(x) for n in INFERRED for x in (n.rpartition(".")[2], n)))
        inferred = inferred.select("package", "class", guessed[F.col("name")].alias("dst")).filter("dst is not null")
        referred = a.filter("kind = 'reference' and names_type is not null").select("package", "class", F.col("names_type").alias("dst"))
        coupled = self._with_outer(targets.unionByName(called).unionByName(inferred).unionByName(referred).distinct()).select("class", "dst").unionByName(imported).distinct()
        cbo = coupled.filter("class != dst").groupBy("class").agg(F.count("*").alias("CBO"))

        # a class's own text only: nested declarations answer for themselves
        declared = t["members"].filter("member_kind != 'field'").select("class", F.concat_ws("#", "class", F.regexp_replace("member", "<[^()]*>| ", "")).alias("target")).distinct()
        signature = self.t["members"].filter("member_kind = 'method'").groupBy(F.col("class").alias("declaring"), F.col("name").alias("last"), F.col("params").alias("arity")).agg(F.min(F.regexp_replace("member", "<[^()]*>| ", "")).alias("text"))
        calls = a.filter("kind = 'call' and declaring is not null").select("class", "declaring", "last", "arity").distinct().join(signature, ["declaring", "last", "arity"], "left")
        calls = calls.select("class", F.concat_ws("#", "declaring", F.coalesce("text", F.concat_ws("/", "last", F.col("arity").cast("string")))).alias("target"))
        made = a.filter("kind in ('new', 'explicit-call') and declaring is not null").select("class", "declaring", F.substring(F.element_at("steps", -1), 3, 9).cast("long").alias("arity")).distinct()
        constructor = self.t["members"].filter("member_kind = 'constructor'").groupBy(F.col("class").alias("declaring"), F.col("params").alias("arity")).agg(F.min(F.regexp_replace("member", "<[^()]*>| ", "")).alias("text"))
        made = made.join(constructor, ["declaring", "arity"], "left").select("class", F.concat_ws("#", "declaring", F.coalesce("text", F.concat(F.lit("new/"), F.col("arity").cast("string")))).alias("target"))
        referred = a.filter("kind = 'reference' and names_type is not null").select("class", F.concat_ws("#", "names_type", F.concat(F.col("name"), F.lit("()"))).alias("target"))
        rfc = declared.unionByName(calls).unionByName(made).unionByName(referred).distinct().groupBy("class").agg(F.count("*").alias("RFC"))

        passing = a.filter("kind = 'call' and declaring is not null").select("package", "class", "declaring")
        mpc = self._with_outer(passing).filter("class != declaring").groupBy("class").agg(F.count("*").alias("MPC"))

        held = t["nodes"].filter("member_kind = 'field' and kind = 'variable'").select(*CLASS, "type").distinct().filter(_dims(F.col("type")) == 0).select(*CLASS, _bare(F.col("type")).alias("name")).distinct()
        dac = type_targets(held, t, self.types).filter("target is not null").select("class", "target").distinct().groupBy("class").agg(F.count("*").alias("DAC"))

        name, params, shape, returns = F.col("name"), F.col("params"), F.col("kind"), F.col("type")
        direct = (params == 0) & (shape == "return-name")
        accessor = (name.startswith("get") & direct & (returns != "void")) | (name.startswith("is") & direct & (returns == "boolean")) | (name.startswith("set") & (params == 1) & (returns == "void"))
        trivial = shape.isin("none", "empty", "return-name", "return-call", "return-nothing", "call", "assign-names")
        methods = t["members"].filter("member_kind = 'method'")
        woc = methods.groupBy("class").agg((F.count_if(~accessor & ~name.isin(*BOILERPLATE) & ~trivial) / F.count("*")).alias("WOC"))

        out = t["classes"].select("class", "class_kind").dropDuplicates(["class"])
        for part in (cbo, rfc, mpc, dac, woc, self.sizes()):
            out = out.join(part, "class", "left")
        out = out.na.fill(0, ["CBO", "RFC", "MPC", "DAC"]).na.fill(0.0, ["WOC"])
        return out.select("class", "CBO", F.when(F.col("class_kind") != "interface", F.col("RFC")).alias("RFC"), "MPC", "DAC", "WOC", "SIZE2")

    def variables_and_callees(self) -> DataFrame:
        """Per method: NOAV (distinct variables, parameters and fields named) and CINT (distinct methods called)."""
        t = self.t
        nodes = t["nodes"].filter("kind != 'statement' and member_kind = 'method'")
        local = nodes.filter("kind in ('parameter', 'variable', 'lambda-parameter', 'catch', 'instanceof', 'pattern') and name is not null").select(*METHOD, "name").distinct()
        seen = nodes.filter("kind = 'name'").select(*METHOD, "name").distinct().join(local, [*METHOD, "name"], "left_semi")
        fields = self.accesses.filter("kind = 'name' and member_kind = 'method' and declaring is not null").select(*METHOD, "name")
        noav = seen.unionByName(fields).distinct().groupBy(*METHOD).agg(F.count("*").alias("NOAV"))
        called = self.accesses.filter("kind = 'call' and member_kind = 'method' and declaring is not null").select(*METHOD, "declaring", "last", "arity").distinct()
        return t["members"].filter("member_kind = 'method'").select(*METHOD).distinct().join(noav, METHOD, "left").join(called.groupBy(*METHOD).agg(F.count("*").alias("CINT")), METHOD, "left").na.fill(0, ["NOAV", "CINT"])

    def declared(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """classes (class, package), methods (class, signature, visibility, is_static), fields (class, name, visibility)."""
        owners = self.t["classes"].select(*CLASS, "class_kind", F.col("modifiers").alias("owner_modifiers")).dropDuplicates(["class"])
        rows = self.t["members"].join(owners.drop("class_kind"), CLASS)
        seen = visibility(F.col("modifiers"), F.col("owner_modifiers"), F.col("class_kind") == "interface")
        methods = rows.filter("member_kind = 'method'").select("class", F.col("member").alias("signature"), seen.alias("visibility"), F.array_contains("modifiers", "static").alias("is_static"))
        fields = rows.filter("member_kind = 'field'").select("class", "path", "package", "member", seen.alias("visibility"))
        names = self.t["nodes"].filter("member_kind = 'field' and kind = 'variable'").select(*METHOD, "name")
        return owners.select("class", "package"), methods, names.join(fields, METHOD).select("class", "name", "visibility")
