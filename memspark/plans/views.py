"""Engine views over the driver's tables: the same rows for every query, by plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.constants import STATUS_WEIGHT, TYPE_BOOST

AS_OF = "2024-06-01 00:00:00"
TYPES, STATES = tuple(TYPE_BOOST), tuple(STATUS_WEIGHT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index) -> object:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def memory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), F.col("text").alias("memory"), "source", _pick(TYPES, i % 13).alias("memory_type"), _pick(STATES, i % 8).alias("status"),
        ((i * 7 % 11) / 10.0).alias("importance"), F.concat(F.lit("cli-"), (i % 37).cast("string")).alias("client_id"), (i % 50).alias("session_id"),
        F.expr(f"timestamp '{AS_OF}' - make_dt_interval(cast(doc_id % 400 as int), cast(doc_id % 24 as int))").alias("created_at"),
    )


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have a vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return memory_text(spark, sf_dir).join(e, "id")


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward events: the memory is the user, the reward in whole hundredths of the value."""
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.floor("value") - 50) / 100.0))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("reward_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("memory_id"), F.col("event_type").alias("reward_type"), v.alias("reward"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", "text")


def crm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of deals: stages by the order's key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"), F.concat(F.lit("cli-"), (F.col("o_custkey") % 37).cast("string")).alias("client_id"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    before = _pick(("negotiation", "delivered", "invoiced", "new", "qualified", ""), F.col("deal_id") % 6)
    after = _pick(("won", "invoiced", "paid", "lost", "negotiation", "closed", "cancelled"), F.col("deal_id") % 7)
    return o.where("deal_id % 11 != 0").select("deal_id", "client_id", before.alias("stage")), o.where("deal_id % 13 != 0").select("deal_id", "client_id", "value", after.alias("stage"))


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A prediction for each order, and an outcome for each whose first shipment is known; one in five has no reward."""
    o = table(spark, sf_dir, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("cli-"), (F.col("o_custkey") % 37).cast("string")).alias("client_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.array(F.col("o_custkey") % 100, F.col("o_orderkey") % 100).alias("memory_ids_used"))
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("shipped"))
    out = o.join(first, F.col("o_orderkey") == F.col("id")).where("id % 3 != 0")
    out = out.select(F.col("id").alias("prediction_id"), F.col("shipped").cast("timestamp").alias("ts"), F.datediff("shipped", "o_orderdate").alias("days_to_resolve"), F.expr("if(id % 5 = 0, null, (id % 21 - 10) / 10.0D)").alias("reward"))
    return p, out


def leads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of leads, by the customer's key."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_id"), F.concat(F.lit("cli-"), (F.col("c_custkey") % 37).cast("string")).alias("company_id"))
    before = _pick(("new", "qualified", "proposal", "negotiation", ""), F.col("lead_id") % 5)
    after = _pick(("qualified", "proposal", "negotiation", "won", "lost", "dead", "closed"), F.col("lead_id") % 7)
    return c.where("lead_id % 11 != 0").withColumn("stage", before), c.where("lead_id % 13 != 0").withColumn("stage", after)


def usefulness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as they stand in the store: contexts, missing layers, dates and calibrations by the customer's key."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey memory_id", "if(c_custkey % 4 = 0, 'sales', 'default') experience", "(c_custkey % 151 - 50) / 100.0D q_value", "(c_custkey % 131 - 40) / 100.0D q_action",
        "if(c_custkey % 3 = 0, null, (c_custkey % 7) / 10.0D) q_hypothesis", "if(c_custkey % 5 = 0, null, (c_custkey % 9) / 10.0D) q_fit", "cast(c_custkey % 12 as int) q_visits",
        "element_at(array('', null, 'high', 'low'), cast(c_custkey % 4 + 1 as int)) calibration", "if(c_custkey % 17 = 0, null, date_format(date_add(date '2024-01-01', cast(c_custkey % 60 as int)), 'yyyy-MM-dd')) q_updated_at",
        "(c_custkey % 21 - 10) / 10.0D last_reward",
    )


def retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalls of a session: the views of a user."""
    return table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr(
        "event_id id", "user_id session_id", "cast(ts as timestamp) ts", "concat('Ran: x\n', if(event_id % 3 = 0, 'ab', concat(' look at item ', event_id)), '\n/tmp/y') query",
        "transform(array(3, 5, 7, 11, 13, 17, 19), k -> event_id % (k * 10)) memory_ids", "array((event_id % 100) / 99.0D, (event_id % 7) / 7.0D) scores",
    )


SUMMARIES = ("Ran: gmail inbox", "Ran: read_email from: a", "Ran: read_email in:sent", "Ran: send_email x", "Ran: grep TODO", "Ran: git commit -m x", "add_memory note", "updated leads.csv", "plain work", "Edited /home/me/x.py")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session did: the other events of a user."""
    return table(spark, sf_dir, "events").where("event_type != 'view'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), _pick(("Bash", "Edit", "Write"), F.col("event_id") % 3).alias("tool"), _pick(SUMMARIES, F.col("event_id") % 10).alias("summary"),
    )


#: What users begin a message with: calls for a profile, for two, and for none.
OPENINGS = ("Send the invoice and ask for payment: ", "Close the deal with the client. ", "invoice for the client, deal paid: ", "", "lead ", "Клієнт просить пропозицію. ")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said, with an opening; one in nine only confirms."""
    text = F.when(F.col("pos") % 9 == 4, F.lit(" Thanks ")).otherwise(F.concat(_pick(OPENINGS, (F.col("session_id") + F.col("pos")) % len(OPENINGS)), "text"))
    return messages(spark, sf_dir).where("role = 'user'").select("session_id", "pos", text.alias("text"))


def prompt_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of the sessions whose id is divisible by 50, each with a vector of the table; one session has no name."""
    rows = prompts(spark, sf_dir).where("session_id % 50 = 0").select((F.col("session_id") * 1000 + F.col("pos")).alias("query_id"), F.when(F.col("session_id") == 0, "unknown").otherwise(F.col("session_id").cast("string")).alias("session_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("query_vector"))
    return rows.withColumn("_v", F.col("query_id") % 499).join(vectors, "_v").drop("_v")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with vectors that lie close in sevens: the first one's vector and a quarter of the row's own; four in five are active."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("own"))
    first = e.select(F.col("id").alias("_f"), F.col("own").alias("base"))
    v = e.join(first, F.col("_f") == F.col("id") - F.col("id") % 7).select("id", F.zip_with("base", "own", lambda a, b: a.cast("double") + 0.25 * b.cast("double")).alias("vector"))
    status = F.when(F.col("id") % 5 == 3, "archived").otherwise("active")
    return memory_text(spark, sf_dir).withColumn("status", status).join(v, "id")


#: Names of topics, whose words stand in many texts or in few.
TOPICS = ("the-thing reer", "que_tion", "Heth  Ing", "des les", "ou ch", "erheblich-sehr selten")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread for each nation: two topics and two of the ten chunks of sessions."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("thread"), F.array(k % 10, (k * 3 + 1) % 10).alias("chunks"), F.array(_pick(TOPICS, k % 6), _pick(TOPICS, (k * 5 + 2) % 6)).alias("topic_names"))
