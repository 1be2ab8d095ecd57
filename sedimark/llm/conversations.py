"""Problem 1: whole conversations from single message rows.

Messages that carry their conversation's identifier belong to it; those that lack one are joined over reply and quote
links to one another and to the conversations that they answer, a conversation being a connected component. Then
messages are put in order of time and conversations that are broken, empty or lack a reply are dropped. Texts aren't
carried through any of this: a message knows whether it has a text and which row holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions.identity import canonical_id, has_text, hook_name, outer_trim
from sedimark.llm.components import connected_components
from sedimark.operators.ordered import positions
from sedimark.runtime import staged

#: Edges of events that quote or answer another event.
QUOTES = ("derived_from", "references")


def hook_messages(hooks: DataFrame, ledger: DataFrame) -> DataFrame:
    """(node, conversation, session_id, speaker, prompt, prompt_id, event, at, has, text_id) of prompts and stops, one row per message.

    Copies (same session, hook name and prompt; without a session the same hook name and prompt) are one message; rows
    without prompt are never copies, rows without hook_id no messages. node is its smallest hook_id, text_id the
    smallest hook_id of a copy with a text (of any copy if none has one), has whether there is one. prompt_id is in its
    plainest stored spelling, prompt canonical, conversation the canonical session_id. event is the smallest of the
    copies' event ids that the ledger has (or the smallest of all), at the earliest time of that event's rows.
    """
    name = hook_name(F.col("hook_event_name"))
    text = F.when(name == "userpromptsubmit", F.col("prompt")).otherwise(F.col("last_assistant_message"))
    rows = hooks.where("hook_id is not null").where(name.isin("userpromptsubmit", "stop")).select(
        "hook_id", canonical_id(F.col("session_id")).alias("conversation"), F.lower(outer_trim(F.col("session_id"))).alias("session_id"), name.alias("name"),
        canonical_id(F.col("prompt_id")).alias("prompt"), "prompt_id", canonical_id(F.col("event_id")).alias("event"), has_text(text).alias("has"),
    )
    # combined by event before the join, so that an event of very many copies is one row
    times = ledger.select(canonical_id(F.col("event_id")).alias("event"), "event_timestamp").where("event is not null and event_timestamp is not null").groupBy("event").agg(F.min("event_timestamp").alias("at"))
    plain = F.struct((F.col("prompt_id") != F.col("prompt")).alias("odd"), "hook_id")
    messages = rows.join(times, "event", "left").withColumn("alone", F.when(F.col("prompt").isNull(), F.col("hook_id"))).groupBy("conversation", "name", "prompt", "alone").agg(
        F.min("hook_id").alias("node"), F.min("session_id").alias("session_id"), F.min_by("prompt_id", plain).alias("prompt_id"), F.min(F.when(F.col("at").isNotNull(), F.struct("event", "at"))).alias("known"), F.min("event").alias("any_event"),
        F.max("has").alias("has"), F.min(F.when(F.col("has"), F.col("hook_id"))).alias("text_id"),
    )
    speaker = F.when(F.col("name") == "stop", "assistant").otherwise("user").alias("speaker")
    return messages.select("node", "conversation", "session_id", speaker, "prompt", "prompt_id", F.coalesce("known.event", "any_event").alias("event"), F.col("known.at").alias("at"), "has", F.coalesce("text_id", "node").alias("text_id"))


def message_links(messages: DataFrame, edges: DataFrame, attach: bool = True) -> DataFrame:
    """(u, v): replies, all messages of a prompt to its first one, and quotes, edges between the events of messages.

    Only links with an end that lacks a conversation count. With attach the other end may be a message of a known
    conversation, which is then stood for by the conversation's smallest node.
    """
    ends = messages.where("conversation is null").select("prompt", "event", "node", F.lit(True).alias("lacking"))
    if attach:
        known = messages.where("conversation is not null")
        reps = known.groupBy("conversation").agg(F.min("node").alias("rep"))
        ends = ends.union(known.join(reps, "conversation").select("prompt", "event", F.col("rep").alias("node"), F.lit(False).alias("lacking")))
    of_prompt = ends.where("prompt is not null")
    first = of_prompt.groupBy("prompt").agg(F.min("node").alias("v"), F.max("lacking").alias("any")).where("any").select("prompt", "v")
    replies = of_prompt.join(first, "prompt").select(F.col("node").alias("u"), "v")
    # one row per event, so that an event of many messages and edges gives no pairs of them
    of_event = ends.where("event is not null").groupBy("event").agg(F.min("node").alias("node"), F.max("lacking").alias("lacking"))
    same = ends.where("event is not null and lacking").join(of_event.select("event", F.col("node").alias("v")), "event").select(F.col("node").alias("u"), "v")
    quoted = edges.where(F.col("edge_type").isin(*QUOTES)).select(canonical_id(F.col("source_event_id")).alias("source"), canonical_id(F.col("target_id")).alias("target")).distinct()
    side = lambda end, node, flag: of_event.select(F.col("event").alias(end), F.col("node").alias(node), F.col("lacking").alias(flag))
    quotes = quoted.join(side("source", "u", "lu"), "source").join(side("target", "v", "lv"), "target").where("lu or lv").select("u", "v")
    return replies.union(same).union(quotes).where("u <> v")


def resolved(messages: DataFrame, links: DataFrame) -> DataFrame:
    """messages with a conversation for all, and identified: whether they had one.

    Those without get their connected component over links, found by alternating large-star and small-star joins. A
    component that reaches exactly one known conversation belongs to it; any other is a conversation of its own.
    """
    lacking, known = messages.where("conversation is null"), messages.where("conversation is not null")
    reps = known.groupBy("conversation").agg(F.min("node").alias("node"), F.min("session_id").alias("session_id"))
    links = staged(links, "message-links")
    ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    reached = reps.join(ends, "node", "left_semi")
    found = connected_components(lacking.select("node").union(reached.select("node")), links)
    owner = found.join(reached, "node").groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("conversation", "session_id")).alias("one")).where("n = 1").select("component", "one.*")
    own = lacking.drop("conversation", "session_id").join(found, "node").join(owner, "component", "left")
    own = own.withColumn("conversation", F.coalesce("conversation", F.concat(F.lit("component:"), F.col("component").cast("string")))).drop("component").withColumn("identified", F.lit(False))
    return known.withColumn("identified", F.lit(True)).unionByName(own)


def whole_conversations(messages: DataFrame) -> DataFrame:
    """(conversation, identified, session_id, msg_no, speaker, prompt_id, text_id) of the messages of whole conversations.

    A conversation is whole if each of its messages has a prompt, a time and a text that isn't blank, and in order of
    time they are pairs of a user and then an assistant message of the same prompt. Of equal times the smaller prompt
    comes first, and of one prompt the user's message. messages are those of `resolved`; they are read twice, the ranges
    being sampled first, so they should come from a written table. Stages.
    """
    complete = F.col("prompt").isNotNull() & F.col("at").isNotNull() & F.col("has")
    thread = messages.select("conversation", "identified", "session_id", "node", "speaker", "prompt", "prompt_id", "text_id", complete.alias("complete"), "at", (F.col("speaker") == "assistant").alias("later"))
    placed = positions(thread, "conversation", ["at", "prompt", "later", "node"], ["prompt"])
    fits = F.when(F.col("row_no") % 2 == 1, F.col("speaker") == "user").otherwise((F.col("speaker") == "assistant") & (F.col("prev_prompt") == F.col("prompt")))
    placed = placed.withColumn("fits", F.coalesce(fits, F.lit(False)) & F.col("complete"))
    broken = placed.groupBy("conversation").agg(F.min("fits").alias("ok"), F.count("*").alias("n")).where("not ok or n % 2 = 1").select("conversation")
    return placed.join(broken, "conversation", "left_anti").select("conversation", "identified", "session_id", F.col("row_no").alias("msg_no"), "speaker", "prompt_id", "text_id")


def with_texts(whole: DataFrame, hooks: DataFrame) -> DataFrame:
    """whole with the text of each message, joined from the row that holds it."""
    texts = hooks.where(hook_name(F.col("hook_event_name")).isin("userpromptsubmit", "stop")).select(F.col("hook_id").alias("text_id"), F.col("prompt").alias("_user"), F.col("last_assistant_message").alias("_assistant"))
    return whole.join(texts, "text_id").withColumn("text", F.when(F.col("speaker") == "user", F.col("_user")).otherwise(F.col("_assistant"))).drop("_user", "_assistant")
