"""Items for the registered queries, derived from the given ``documents`` table.

The documents are invented prose that holds next to no term of the default
lexicon, so each document gets a lead sentence from a small bank of phrases that
reach the branches of the rules. The document's whole text follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weaksift.sources.raw_items import with_defaults

# (source_type, rating, title, phrase)
PHRASES = [
    ("discussion", "", "Weekly billing chores", "I own a two person studio and our billing workflow is scattered over three apps. We still do manual cleanup each Friday because nothing lines up."),
    ("review", "2", "CRM contact sync drops rows", "Our CRM sync fails when a phone field is missing, so my small team fixes customer records by hand. The setup guide did not help."),
    ("discussion", "", "Automation that breaks", "We tried Zapier for invoice reminders, but the automation failed twice a week and the error text is useless."),
    ("review", "0", "n8n credential setup", "I want to run n8n for scheduling, but the credential setup is hard and the permission screen is confusing."),
    ("discussion", "", "Wish for a lighter tool", "I wish there was a simple tool for follow-up notes. Our lean team would pay for it if the onboarding was short."),
    ("discussion", "", "Assistant accuracy", "We use an AI assistant for admin mail, but the answers are wrong often and trust is slow to build in our business."),
    ("review", "5", "Moving away from an old tool", "The migration took weeks and the learning curve is steep. We switched because the old workflow was slow and expensive."),
    ("discussion", "", "Open position", "We are hiring a full-time designer. Apply now, the salary range and benefits are on our careers page."),
    ("discussion", "", "Remote job board", "I found a remote job that asks for a video, it is annoying and I had to apply twice because the form broke."),
    ("review", "", "All-in-one suite", "Our platform will unlock growth. Book a demo and get started with a world-class suite."),
    ("review", "", "Vendor listing", "Company profile: founded in 2011, provider of ledgers, number of employees 40. Pricing, reviews and more in this directory."),
    ("discussion", "", "About the makers", "We are a studio with a revolutionary planner that saves hours every week."),
    ("discussion", "", "Short note", "Nice post."),
    ("review", "", "Untitled", "Blue table near window."),
    ("discussion", "", "Show HN: my planner", "I built a planner and I just launched it this week. Would love feedback because it is new, check out the landing page."),
    ("discussion", "", "Launch with real pain", "I built a script because our invoicing workflow fails every month and my small business has manual work to redo."),
    ("discussion", "", "Two links", "I think you need https://a.example and https://b.example because the scheduling setup is hard for a solo owner."),
    ("discussion", "", "Favorite film scene", "I keep saying this movie quote is my favorite because the character is hard to read."),
    ("discussion", "", "Scene in the office", "My customer said the film scene with the broken CRM is funny, but our own workflow error is a real problem."),
    ("review", "1", "Stack trace in server runtime", "The python library throws a stack trace in the runtime when the docker container sends a json request, wrong response again."),
    ("review", "1", "Token refresh", "I need the oauth token and the endpoint, the issue is a missing header."),
    ("review", "3", "Corporate portal", "The enterprise portal has a slow support tool and it is frustrating for a large organization."),
    ("discussion", "", "According to the paper", "I have a problem with this claim, according to the paper it rains more because of trees."),
    ("review", "4", "Sales notes", "I use this for marketing notes and it is a pain sometimes."),
    ("review", "3", "Team chat next to the tracker", "We tried Jira and Asana with Slack, but our follow-up tasks are scattered and I need a better export."),
    ("review", "2", "Posting rows", "Zapier workflow posts json to a python endpoint on a server, wrong order every time."),
    ("review", "2", "Package tool", "I tried the package and the library of this tool, it is hard to configure."),
    ("forum", "", "Solo owner question", "I am a solo owner and the switching cost of a complicated tool is too much for my company."),
]


def seeded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items with ``source_index`` and ``run_id``; ``content_key`` is equal for exact copies of a
    document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ("source_type", "rating", "title", "phrase")
    bank = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, row)]) for row in PHRASES])
    lead = documents.withColumn("lead", F.element_at(bank, (F.col("doc_id") % len(PHRASES) + 1).cast("int")))
    items = lead.select(
        (F.col("doc_id") + 1).alias("source_index"),
        F.concat(F.lit("run-"), F.lpad(F.regexp_extract("source", r"(\d+)", 1), 2, "0")).alias("run_id"),
        F.col("lead.source_type").alias("source_type"),
        F.col("source").alias("source_name"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.concat(F.lit("https://items.example/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.col("lead.title").alias("title"),
        F.col("lang").alias("author"),
        F.concat(F.lit("theme-"), "lang").alias("product_theme"),
        F.col("lang").alias("query_theme"),
        F.col("lead.rating").alias("rating"),
        F.concat("lead.phrase", F.lit(" "), "text").alias("text"),
        (F.col("doc_id") % 50 == 0).alias("is_demo_fallback"),
        F.md5("text").alias("content_key"),
    )
    return with_defaults(items)


def native_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are, for a lexicon made for them."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_defaults(
        documents.select(
            (F.col("doc_id") + 1).alias("source_index"),
            F.lit("native").alias("run_id"),
            F.when(F.col("lang") == "en", "review").otherwise("discussion").alias("source_type"),
            F.col("source").alias("source_name"),
            F.col("doc_id").cast("string").alias("source_id"),
            F.col("lang").alias("author"),
            F.col("lang").alias("query_theme"),
            "text",
        )
    )
