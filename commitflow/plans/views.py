"""Commit-shaped views over the given tables: Spark frames, and the same views as DuckDB SQL.

Every view reads a whole table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cycles of change types used by the derived commit records.
MIXED_A = ("MODIFY", "ADD", "RENAME")
MIXED_B = ("UNKNOWN", "COPY", "RENAME")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Deal out a scan that is too small to fill the cores; larger ones are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _lines(text: str = "text"):
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per document: the first line is the message, every line is one file change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    src = spread(docs).select("doc_id", "lang", "source", _lines().alias("lines"))

    def change(x, i):
        turn = ((F.col("doc_id") + i) % 3).cast("int")
        pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), turn)
        last = F.col("doc_id") % 10
        return F.struct(
            F.when(last < 6, F.lit("MODIFY"))
            .when(last == 6, F.lit("ADD"))
            .when(last == 7, F.lit("DELETE"))
            .when(last == 8, pick(MIXED_A))
            .otherwise(pick(MIXED_B))
            .alias("change_type"),
            F.concat(F.lit("src/f"), i.cast("string"), F.lit(".txt")).alias("old_path"),
            F.concat(F.lit("src/g"), i.cast("string"), F.lit(".txt")).alias("new_path"),
            F.concat(F.lit("+"), x, F.lit("\n")).alias("diff"),
        )

    return src.filter(F.size("lines") > 0).select(
        "doc_id",
        F.col("lang").alias("language"),
        F.col("source").alias("repo"),
        F.get("lines", F.lit(0)).alias("message"),
        F.transform("lines", change).alias("mods"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of every document, with the outputs of two pretended models."""
    w = F.array_remove(F.split("sentence", " "), "")
    sentences = (
        spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
        .select("doc_id", "lang", F.posexplode(F.split("text", "[.\n]+")).alias("pos", "sentence"))
        .select((F.col("doc_id") * 1000000 + F.col("pos")).alias("id"), "lang", w.alias("w"))
        .filter(F.size("w") > 0)
    )
    turn = F.col("id") % 3
    joined = lambda c: F.array_join(c, " ")
    return sentences.select(
        "id",
        F.col("lang").alias("split"),
        joined(F.col("w")).alias("target"),
        joined(F.filter("w", lambda x, i: i % 5 != 4)).alias("model_a"),
        F.when(turn == 0, joined(F.slice("w", F.lit(2), F.size("w"))))
        .when(
            turn == 1,
            joined(
                F.concat(F.slice("w", F.lit(3), F.size("w")), F.slice("w", F.lit(1), F.lit(2)))
            ),
        )
        .otherwise(joined(F.col("w")))
        .alias("model_b"),
    )


def judge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("input"),
        ((F.col("doc_id") * 7) % 10 + 1).cast("int").alias("tiny_score"),
        ((F.col("doc_id") * 3 + F.col("n_chars")) % 10 + 1).cast("int").alias("baseline_score"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with missing ids, and repeated ids from a later file."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0")
    cid = F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("custom_id")
    n = F.col("n_chars").cast("string")
    first = d.select(
        cid,
        (F.col("doc_id") % 5).cast("int").alias("file_no"),
        F.col("doc_id").alias("line_no"),
        F.concat(F.lit("simplified "), n).alias("content"),
    )
    again = d.filter("doc_id % 7 = 0").select(
        cid,
        F.lit(9).alias("file_no"),
        F.col("doc_id").alias("line_no"),
        F.concat(F.lit("retry "), n).alias("content"),
    )
    return first.unionByName(again)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors with labels; ten positions per example."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("example_id"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        F.when(F.col("vec_id") % 13 == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"),
        F.col("embedding").cast("array<double>").alias("scores"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 7).alias("run"),
        F.col("role").alias("split"),
        (F.col("conv_id") % 3).alias("epoch"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("step"),
        F.length("text").cast("bigint").alias("tokens"),
    )


def raw_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.array_join(
            F.transform(
                F.split("text", "\n"),
                lambda x, i: F.when(
                    i % 4 == 2,
                    F.concat(F.lit("@@ -"), i.cast("string"), F.lit(" @@\n "), x, F.lit("   ")),
                ).otherwise(F.concat(F.lit("+  "), x)),
            ),
            "\n",
        ).alias("raw"),
    )


def name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*[F.lit(x) for x in ("A", "M", "D", "R100")])

    def line(i):
        turn = ((F.col("doc_id") + i) % 4).cast("int")
        tail = F.when(turn == 3, F.concat(F.lit("\tsrc/g"), i.cast("string"), F.lit(".txt")))
        return F.concat(
            F.get(letters, turn),
            F.lit("\tsrc/f"),
            i.cast("string"),
            F.lit(".txt"),
            F.coalesce(tail, F.lit("")),
        )

    lines = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), line)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("ns"))


# The same views for the SQL check. List positions in lambdas are 1-based here.
SQL: dict[str, str] = {
    "commits": """
select doc_id, lang as language, source as repo, lines[1] as message,
  list_transform(lines, lambda x, i: {'change_type':
    case when doc_id%10<6 then 'MODIFY' when doc_id%10=6 then 'ADD' when doc_id%10=7 then 'DELETE'
         when doc_id%10=8 then ['MODIFY','ADD','RENAME'][cast((doc_id+i-1)%3 as int)+1]
         else ['UNKNOWN','COPY','RENAME'][cast((doc_id+i-1)%3 as int)+1] end,
    'old_path': 'src/f'||(i-1)||'.txt', 'new_path': 'src/g'||(i-1)||'.txt',
    'diff': '+'||x||chr(10)}) as mods
from (select doc_id, lang, source,
        list_filter(string_split(text,chr(10)), lambda x: length(trim(x))>0) as lines from documents)
where len(lines)>0""",
    "predictions": """
select id, split, array_to_string(w,' ') as target,
  array_to_string(list_filter(w, lambda x, i: (i-1)%5<>4),' ') as model_a,
  case when id%3=0 then array_to_string(w[2:],' ')
       when id%3=1 then array_to_string(list_concat(w[3:],w[1:2]),' ')
       else array_to_string(w,' ') end as model_b
from (select doc_id*1000000+pos-1 as id, lang as split,
        list_filter(string_split(sentence,' '), lambda x: x<>'') as w
      from (select doc_id, lang, unnest(parts) as sentence, generate_subscripts(parts,1) as pos
            from (select doc_id, lang, regexp_split_to_array(text, '[.\\n]+') as parts
                  from documents)))
where len(w)>0""",
    "judge_results": """
select doc_id, text as input, cast((doc_id*7)%10+1 as int) as tiny_score,
  cast((doc_id*3+n_chars)%10+1 as int) as baseline_score from documents""",
    "responses": """
select 'r'||doc_id as custom_id, cast(doc_id%5 as int) as file_no, doc_id as line_no,
  'simplified '||n_chars as content from documents where doc_id%11<>0
union all
select 'r'||doc_id, 9, doc_id, 'retry '||n_chars from documents where doc_id%7=0 and doc_id%11<>0""",
    "ranked": """
select vec_id//10 as example_id, cast(vec_id%10 as int) as pos,
  case when vec_id%13=0 then -100 else label end as label, cast(embedding as double[]) as scores
from embeddings""",
    "steps": """
select conv_id%7 as run, role as split, conv_id%3 as epoch, conv_id*1000+turn as step,
  length(text) as tokens from conversations""",
    "raw_diffs": """
select doc_id, array_to_string(list_transform(string_split(text,chr(10)), lambda x, i:
  case when (i-1)%4=2 then '@@ -'||(i-1)||' @@'||chr(10)||' '||x||'   ' else '+  '||x end),
  chr(10)) as raw from documents""",
    "name_status": """
select doc_id, array_to_string(list_transform(range(0,doc_id%4+1), lambda i:
  ['A','M','D','R100'][cast((doc_id+i)%4 as int)+1]||chr(9)||'src/f'||i||'.txt'||
  case when (doc_id+i)%4=3 then chr(9)||'src/g'||i||'.txt' else '' end), chr(10)) as ns
from documents""",
}

# C1 as SQL over one change record ``m``.
SQL["rendered"] = """
select *, array_to_string(list_transform(list_filter(mods, lambda m: m.change_type<>'UNKNOWN'),
  lambda m: case m.change_type when 'ADD' then 'new file '||m.new_path
    when 'DELETE' then 'deleted file '||m.old_path
    when 'RENAME' then 'rename from '||m.old_path||chr(10)||'rename to '||m.new_path
    when 'COPY' then 'copy from '||m.old_path||chr(10)||'copy to '||m.new_path
    else m.new_path end||chr(10)||m.diff), '') as diff
from commits"""

_NEEDS = {"rendered": ("commits",)}


def with_sql(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """Prefix ``body`` with the named views (and further named subqueries) as CTEs."""
    ordered: list[str] = []
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            if need not in ordered:
                ordered.append(need)
    parts = [f"{n} as ({SQL[n]})" for n in ordered]
    parts += [f"{n} as ({q})" for n, q in extra.items()]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"
