"""The given tables seen as repositories, files, commits, requests, transcripts.

Plain projections, unions and small aggregates, so that every derived table
grows with the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.params import BudgetParams, CandidateParams
from corpusmill.schemas import LAYERS

DIRECTORIES = ("src/", "lib/core/", "node_modules/dep/", "tests/", "api/build/gen/", "")
SUFFIXES = (
    ".py", ".js", ".ts", ".css", ".sql", ".md", ".go", ".java", ".php", ".blade.php", ".d.ts", "",
)
ERROR_STAGES = ("clone", "agent", "write")
ERROR_TEXTS = (
    "HTTP 401: invalid key",
    "exit 1: 403 Forbidden",
    "HTTP 429 too many requests",
    "HTTP 503 upstream",
    "read timeout after 300 s",
    "You have hit your usage limit",
    "exit 14030 from tool",
    "disk is full",
)
RUN_BUDGET = BudgetParams(target_loc=400, tolerance_loc=50, cap_loc=900)
# The given texts are short, so is the budget.
BUDGET = BudgetParams(target_loc=100, tolerance_loc=10, cap_loc=130)
CANDIDATES = CandidateParams(
    min_loc=2, preferred_min_loc=5, preferred_max_loc=20, partial_above_loc=40
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _document_repo() -> Column:
    number = F.substring("source", 4, 9).cast("int")
    return F.concat(
        F.lit("https://git.example.com/group"), (number % 5).cast("string"), F.lit("/"),
        F.col("source"), F.when(number % 2 == 0, ".git").otherwise(""),
    )


def _document_path() -> Column:
    return F.concat(
        _pick(DIRECTORIES, F.col("doc_id")), F.lit("f"), F.col("doc_id").cast("string"),
        _pick(SUFFIXES, F.floor(F.col("doc_id") / 3)),
    )


def _code_like_text() -> Column:
    """Some lines of each text become comments or blank lines."""
    return F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.when(i % 5 == 4, F.concat(F.lit("  # "), line))
            .when(i % 5 == 3, F.concat(F.lit("// "), line))
            .when(i % 7 == 6, "")
            .otherwise(line),
        ),
        "\n",
    )


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-like texts with lines added (after every ninth) and removed (every thirteenth)."""
    kept = F.transform(
        F.split(_code_like_text(), "\n"),
        lambda line, i: F.when(i % 9 == 5, F.array(line, F.concat(F.lit("inserted after "), i.cast("string"))))
        .when(i % 13 == 12, F.array().cast("array<string>"))
        .otherwise(F.array(line)),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select(
        F.col("source").alias("folder"), _document_path().alias("path"), F.array_join(F.flatten(kept), "\n").alias("text")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _code_like_text().cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select(
        _document_repo().alias("repo_url"), _document_path().alias("path"), content.alias("content")
    ).withColumn("size", F.octet_length("content").cast("bigint"))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to write to disk: hidden folders, names that begin with an underscore, and empty files among them."""
    doc_id, number = F.col("doc_id"), F.col("doc_id").cast("string")
    path = (
        F.when(doc_id % 7 == 0, F.concat(F.lit(".github/"), number, F.lit(".yml")))
        .when(doc_id % 7 == 1, F.concat(F.lit("pkg"), number, F.lit("/__init__.py")))
        .when(doc_id % 7 == 2, F.concat(F.lit(".git/objects/"), number))
        .otherwise(_document_path())
    )
    text = F.when(doc_id % 7 == 1, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("folder"), path.alias("path"), text.cast("binary").alias("content")
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select(F.col("source").alias("folder"), _document_path().alias("path"), "text")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, none = F.col("doc_id"), F.lit(None).cast("int")
    path = _document_path()

    def request(offset: int, when: Column, where: Column, start: Column, end: Column) -> Column:
        row = F.struct(
            (doc_id * 4 + offset).alias("seq"), where.alias("path"),
            start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
        )
        return F.when(when, row)

    narrow, broken = doc_id % 11 == 0, doc_id % 13 == 0
    wanted = F.array(
        request(
            0, F.lit(True), path,
            F.when(narrow, 2).when(broken, 9), F.when(narrow, 6).when(broken, 3),
        ),
        request(1, doc_id % 17 == 0, F.concat(F.lit("./"), path), none, none),
        request(2, doc_id % 19 == 0, F.concat(F.lit("missing/"), path), none, none),
        request(3, doc_id % 7 == 0, path, F.lit(1), F.lit(3)),
    )
    return docs.select(
        _document_repo().alias("repo_url"), _pick(LAYERS, doc_id).alias("layer"),
        F.explode(wanted).alias("r"),
    ).where(F.col("r").isNotNull()).select(
        "repo_url", "r.seq", "r.path", "layer", "r.start_line", "r.end_line"
    )


def _order_repo() -> Column:
    number = F.col("o_custkey") % 200
    return F.concat(
        F.lit("https://git.example.com/org"), (number % 7).cast("string"), F.lit("/team/repo"),
        number.cast("string"), F.lit(".git"),
    )


def _order_sha(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("string"), 256), 1, 40)


def commit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit ids alone; enough for the fingerprint."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.select(
        _order_repo().alias("repo_url"), _order_sha(F.col("o_orderkey")).alias("sha")
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest commit has the smallest position; the oldest has no parent."""
    key = F.col("o_orderkey")
    days = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = orders.select(
        _order_repo().alias("repo_url"),
        _order_sha(key).alias("sha"),
        _order_sha(key - 1).alias("parent"),
        ((F.lit(20000) - days).cast("bigint") * 1000000000 + key).alias("pos"),
        (key % 7 != 0).alias("on_head"),
        (key % 997 == 0).alias("imported"),
    )
    oldest = rows.groupBy("repo_url").agg(F.max("pos").alias("oldest"))
    no_parent = F.col("imported") | (F.col("pos") == F.col("oldest"))
    # One row per repository, of which _order_repo names 200 at most: the commits need not be shuffled to meet it.
    return rows.join(F.broadcast(oldest), "repo_url").select(
        "repo_url",
        "sha",
        F.when(no_parent, F.array().cast("array<string>")).otherwise(F.array("parent")).alias("parents"),
        "pos",
        "on_head",
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        _order_repo().alias("repo_url"),
        F.when(key % 10 == 0, "refs/remotes/origin/HEAD")
        .otherwise(F.concat(F.lit("refs/remotes/origin/b"), key.cast("string")))
        .alias("refname"),
        F.date_trunc("month", "o_orderdate").alias("committer_ts"),
        _order_sha(key).alias("tip_sha"),
    )


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository list file: URLs in several spellings, comments, repeats."""
    pages = table(spark, sf_dir, "pages")
    page = F.col("page_id")
    ssh = F.concat(
        F.lit("git@"), F.regexp_extract("url", "^https?://([^/]+)/", 1), F.lit(":"),
        F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1), F.lit(".git"),
    )
    value = (
        F.when(page % 16 == 7, F.concat(F.lit(" # "), F.col("url")))
        .when(page % 4 == 1, ssh)
        .when(page % 4 == 2, F.concat(F.lit("\t "), F.col("url"), F.lit("/ ")))
        .when(page % 4 == 3, F.concat(F.lit("# "), F.col("url")))
        .otherwise(F.col("url"))
    )
    copies = F.explode(F.when(page % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return pages.select(value.alias("value"), page, copies.alias("copy")).select(
        "value", (F.col("page_id") + F.col("copy") * 100000000).alias("line_no")
    )


def manifest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest version per event; no lines means the run failed."""
    user = F.col("user_id").cast("string")
    # From calendar fields: the column has no time zone, so neither has this.
    second = F.unix_date(F.col("ts").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    version = second.cast("bigint") * 1000000 + (F.expr("extract(SECOND FROM ts)") * 1000000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://git.example.com/u/repo"), user).alias("repo_url"),
        version.alias("version"),
        "event_id",
        F.floor("value").alias("total_loc"),
        (F.col("event_id") % 40).alias("file_count"),
        F.col("event_type").alias("language"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sampled_at"),
    )


def user_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of customers, the input of a resumed run."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://git.example.com/u/repo"), F.col("c_custkey").cast("string")).alias(
            "repo_url"
        )
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        F.concat(F.lit("https://git.example.com/u/repo"), F.col("user_id").cast("string")).alias(
            "repo_url"
        ),
        _pick(ERROR_STAGES, F.col("event_id")).alias("stage"),
        _pick(ERROR_TEXTS, F.col("event_id")).alias("error"),
        "ts",
        "event_id",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts; user turns become tool results."""
    call = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    assistant = F.col("role") == "assistant"
    calls = F.array(
        F.struct(
            call.alias("id"),
            F.lit("save_sample").alias("name"),
            F.concat(F.lit('{"path": "f'), F.col("turn").cast("string"), F.lit('.py"}')).alias(
                "arguments"
            ),
        )
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("pos"),
        F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"),
        F.when(~assistant, call).alias("tool_call_id"),
        F.when(assistant & (F.col("conv_id") % 3 == 0), calls).alias("tool_calls"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as JSON; the conversation number picks a defect."""
    word = F.regexp_replace("text", "[^A-Za-z ]", "")
    text = F.concat(F.lit('"content":"'), word, F.lit('"'))

    def with_calls(calls: str) -> Column:
        return F.concat(F.lit("{"), text, F.lit(f',"tool_calls":{calls}}}'))

    good = '{"name":"bash","arguments_json":"{\\"command\\":\\"ls\\"}"}'
    forms = (
        with_calls(f"[{good},{good}]"),
        with_calls("[]"),
        F.concat(F.lit("{"), text, F.lit("}")),
        with_calls('"none"'),
        with_calls(f"[{good},7]"),
        with_calls('[{"name":"","arguments_json":"{}"}]'),
        with_calls('[{"name":"bash","arguments_json":"not json"}]'),
        with_calls(f'[{good},{{"name":"bash","arguments_json":"[1]"}}]'),
        F.concat(F.lit("["), F.lit("1"), F.lit("]")),
        F.concat(F.lit("{"), text),
    )
    picked = F.element_at(F.array(*forms), (F.col("conv_id") % len(forms) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), picked.alias("payload")
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to remove: every run of three words of the benchmark texts, and of four from every fifth word on.

    Names contain others, and a name that stands in several places has several kinds.
    """
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    count = F.size("words")

    def run(start: Column, n: int) -> Column:
        return F.when(start + n <= count, F.array_join(F.slice("words", start + 1, n), " "))

    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 3, F.lit(0))),
        lambda i: F.struct(i.alias("start"), run(i, 3).alias("three"), F.when(i % 5 == 0, run(i, 4)).alias("four")),
    )
    bench = table(spark, sf_dir, "benchmark").select("item_id", words.alias("words"))
    each = bench.select("item_id", F.explode(runs).alias("r"))
    return each.select(
        F.explode(F.array_compact(F.array("r.three", "r.four"))).alias("name"),
        _pick(("company", "product", "person"), F.col("item_id") + F.col("r.start")).alias("kind"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run results: one per customer, some empty, some with a forced language."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://git.example.com/u/repo"), key.cast("string")).alias("repo_url"),
        F.when(key % 9 == 0, 0).otherwise(key % 6000 + 1).cast("bigint").alias("total_loc"),
        F.when(key % 5 != 0, _pick(("PHP", "Go", "JavaScript"), key)).alias("primary"),
        F.when(key % 9 == 0, 0).otherwise(F.floor((key % 6000 + 1) * (key % 10) / 10)).cast("bigint").alias(
            "primary_loc"
        ),
        (key % 2 == 0).alias("primary_forced"),
    )


def run_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save events of sampling runs: run, turn, lines, layer, language."""
    line = F.col("l_linenumber").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("run_id"),
        ((F.col("l_partkey") + line) % 50).alias("turn"),
        (F.col("l_suppkey") % 9 == 0).alias("saved"),
        F.when(F.col("l_suppkey") % 9 == 0, F.col("l_partkey") % 90 + 10)
        .otherwise(0).cast("bigint").alias("loc"),
        _pick(LAYERS, F.col("l_partkey")).alias("layer"),
        _pick(("PHP", "Go", "JavaScript"), F.col("l_suppkey") + F.col("l_orderkey") % 500).alias("language"),
    )


def run_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary language and strictness of each run."""
    run = (F.col("l_orderkey") % 500).alias("run_id")
    return table(spark, sf_dir, "lineitem").select(run).distinct().select(
        "run_id",
        F.when(F.col("run_id") % 4 != 0, _pick(("PHP", "Go", "JavaScript"), F.col("run_id"))).alias("primary"),
        (F.col("run_id") % 3 == 0).alias("hard"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries of runs: tool calls, saves, and prose now and then."""
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        (key % 5000).alias("run_id"),
        (F.col("l_partkey") % 50).alias("turn"),
        _pick(("bash", "save_sample", "write_summary"), line).alias("tool"),
        ((line % 3 == 1) & (F.col("l_suppkey") % 5 == 0)).alias("saved"),
        (F.col("l_partkey") % 90).alias("loc"),
        F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("note "), (F.col("l_partkey") % 50).cast("string"))).alias(
            "prose"
        ),
    )


def redaction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One redaction run per order; the answer carries the cost as JSON."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    blob = (
        F.when(key % 4 == 0, F.concat(F.lit('{"total_cost_usd": '), price, F.lit("}")))
        .when(key % 4 == 1, F.concat(F.lit('{"cost_usd": '), price, F.lit(', "usage": {"input_tokens": '),
                                     key.cast("string"), F.lit("}}")))
        .when(key % 4 == 2, '{"total_cost_usd": "n/a"}')
        .otherwise("not json")
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("folder"), key.cast("string")).alias("folder"),
        F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"),
        blob.alias("answer"),
    )


def commit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long linear histories with a few merges and abandoned commits."""
    key = F.col("o_orderkey")

    def parent(when: Column, distance: int) -> Column:
        return F.when(when & (key >= distance), (key - distance).cast("string"))

    skips = key % 501 == 0
    parents = F.array(parent(~skips, 20), parent(skips, 40), parent(key % 997 == 0, 60))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://git.example.com/g/repo"), (key % 20).cast("string")).alias("repo_url"),
        key.cast("string").alias("sha"),
        F.array_compact(parents).alias("parents"),
    )


def graph_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = commit_graph(spark, sf_dir).where(F.col("sha").cast("bigint") % 3 == 0)
    newest = F.max(F.col("sha").cast("bigint")).cast("string")
    return heads.groupBy("repo_url").agg(newest.alias("sha"))
