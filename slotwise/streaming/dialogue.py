"""The booking dialogue of all phones as joins, without a serial fold (T-3).

A phone's messages, in (ts, id) order, walk through department → doctor →
date → slot → name.  Which message answers which question depends on what
came before, so a plain fold holds a phone's history in one task.  Here the
walk is put together from steps that any task can find by itself:

* *Segments.*  A cancel or greeting word sets the state whatever came before;
  the messages after one, up to and with the next, are a segment.  Its entry
  is a row of its own, with the state that the word (or the stored session)
  leaves.
* *Nodes.*  Every message that names a department could be an answer to the
  department question.  If it is one, the rest follows: the doctor is chosen
  by the first later message whose number is on that department's menu, the
  date by the first later one on that doctor's menu, then the slot, then the
  name; the message after that opens the next dialogue, and its department is
  the next node.  So a node is a function from "asked for a department" to
  the next node, and entries that start inside a dialogue are nodes as well.
* *Composition.*  The nodes that really occur are those that the entries lead
  to.  Functions are composed with themselves: after k rounds a jump covers
  2^k dialogues, so a phone of n dialogues takes log2(n) rounds.
* *Menus* are tables joined by (department, number), (doctor, number) and
  (doctor, day, number); no menu is collected.

"The first later message such that ..." is :func:`first_after`: a minimum over
the following rows of a slice of positions, and, for what a slice lacks, a
minimum over the later slices of one row each.  No task holds a phone or a
segment, however long.

Defined cases: a number off the menu, an option without dates or slots, and a
name of less than two letters leave the state as it is; a number too large for
32 bits is no choice; messages of equal time are ordered by id; rows that
repeat an id are messages of their own, in no stated order.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.intents import INTENT_CANCEL, INTENT_GREET, INTENT_OTHER, INTENT_STATUS, intent, menu_index
from slotwise.functions.text import normalize_phone, py_strip, title_case
from slotwise.operators import availability, lookups
from slotwise.plans.numbering import number_rows
from slotwise.session import ensure_checkpoint_dir, scratch_path

# Positions per slice: what one window of a long segment holds.
SLICE = 1 << 16
# Picks of a dialogue, in order.
PICKS = ("dept", "doctor_id", "date", "slot")
STATE = "step string, dept string, doctor_id bigint, date string, slot string"


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, into the shared folder."""
    path = scratch_path(df.sparkSession, "dialogue", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def menu_tables(doctors: DataFrame, leaves: DataFrame, appointments: DataFrame, as_of) -> dict[str, DataFrame]:
    """The menus as tables: each option with its number and whether it leads on.

    departments (k, dept); doctors (dept, k, doctor_id, open: has dates);
    dates (doctor_id, k, date, open: has free slots);
    slots (doctor_id, date, k, slot); leaves (doctor_id, date).
    """
    day0 = F.lit(as_of).cast("date")
    horizon = availability.DAYS_AHEAD + availability.EXTRA_SEARCH_DAYS
    ahead = F.date_add(day0, 1), F.date_add(day0, horizon)
    offered = availability.with_date_menu(doctors, leaves, as_of).select(
        F.col("id").alias("doctor_id"), "dates", availability.slot_times().alias("grid")
    )
    listed = lookups.doctors_by_department(doctors.select("id", "department"))
    booked = availability.booked_slot_sets(appointments, F.col("appointment_date").between(*ahead))
    days = offered.select("doctor_id", "grid", F.posexplode("dates").alias("at", "appointment_date"))
    free = days.join(booked, ["doctor_id", "appointment_date"], "left").select(
        "doctor_id", F.col("appointment_date").cast("string").alias("date"), (F.col("at") + 1).alias("k"),
        F.array_except("grid", F.coalesce("_booked", F.array().cast("array<string>"))).alias("free"),
    )
    return {
        "departments": lookups.departments(doctors).select(F.col("menu_no").cast("int").alias("k"), F.col("department").alias("dept")),
        "doctors": listed.join(offered, listed["id"] == offered["doctor_id"]).select(
            F.col("department").alias("dept"), F.col("menu_no").cast("int").alias("k"), "doctor_id", (F.size("dates") > 0).alias("open")
        ),
        "dates": free.select("doctor_id", "k", "date", (F.size("free") > 0).alias("open")),
        "slots": free.select("doctor_id", "date", F.posexplode("free").alias("at", "slot")).select(
            "doctor_id", "date", (F.col("at") + 1).alias("k"), "slot"
        ),
        "leaves": leaves.where(F.col("leave_date").between(*ahead)).select(
            "doctor_id", F.col("leave_date").cast("string").alias("date")
        ).distinct(),
    }


# ----------------------------------------------------------------------------- first after, last before


def _nearest(rows: DataFrame, keys: list[str], values: dict[str, Column], later: bool) -> DataFrame:
    pick = F.min if later else F.max
    part = F.floor(F.col("p") / SLICE).alias("_slice")
    sliced = rows.select("*", part, *[v.alias(f"_v_{n}") for n, v in values.items()])
    # Later rows come first in a descending order: a frame that grows is added up
    # row by row, one that shrinks would be gone through anew for each row.
    span = (Window.unboundedPreceding, -1)
    order = F.desc if later else F.asc
    inside = Window.partitionBy(*keys, "_slice").orderBy(order("p")).rangeBetween(*span)
    across = Window.partitionBy(*keys).orderBy(order("_slice")).rowsBetween(*span)
    here = sliced.select("*", *[pick(f"_v_{n}").over(inside).alias(f"_in_{n}") for n in values])
    ends = sliced.groupBy(*keys, "_slice").agg(*[pick(f"_v_{n}").alias(f"_e_{n}") for n in values])
    ends = ends.select(*keys, "_slice", *[pick(f"_e_{n}").over(across).alias(f"_out_{n}") for n in values])
    found = [F.coalesce(f"_in_{n}", f"_out_{n}").alias(n) for n in values]
    return here.join(ends, [*keys, "_slice"]).select(*rows.columns, *found)


def first_after(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """``rows`` with, for each name, the least value at a later position ``p`` of the same keys.

    Values must grow with ``p`` (positions, or structs that begin with one);
    rows without one have null there.
    """
    return _nearest(rows, keys, values, True)


def last_before(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """As :func:`first_after`, the greatest value at an earlier position."""
    return _nearest(rows, keys, values, False)


# ----------------------------------------------------------------------------- messages, segments


def _messages(tagged: DataFrame) -> DataFrame:
    """Messages with their position in the phone, what they could answer, and their segment."""
    text = tagged.select("id", normalize_phone("phone").alias("phone"), "ts", "text")
    placed = number_rows(text, ["phone"], ["ts", "id"], "p", [F.date_trunc("hour", "ts")])
    name = title_case(py_strip("text"))
    other = F.col("intent") == INTENT_OTHER
    said = placed.withColumn("intent", intent("text")).select(
        "*", F.when(other, menu_index("text")).alias("k"), F.when(other & (F.length(name) >= 2), name).alias("name")
    )
    reset = F.when(F.col("intent").isin(INTENT_CANCEL, INTENT_GREET), F.struct("p", "intent"))
    cut = last_before(said, ["phone"], reset=reset)
    return cut.select("*", F.coalesce("reset.p", F.lit(0)).cast("bigint").alias("seg")).drop("reset")


def _entries(messages: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """One row per segment with messages: (phone, seg, p = seg, state), the state it begins in."""
    after = messages.where(F.col("intent").isin(INTENT_CANCEL, INTENT_GREET)).select(
        "phone", F.col("p").alias("seg"), F.when(F.col("intent") == INTENT_GREET, "choose_dept").otherwise("start").alias("step"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in STATE.split(", ")[1:])],
    )
    known = messages.select("phone").distinct().withColumn("seg", F.lit(0).cast("bigint"))
    if sessions is None:
        first = known.select("*", F.lit("start").alias("step"), *[F.lit(None).alias(c) for c in PICKS])
    else:
        stored = sessions.select(normalize_phone("phone").alias("phone"), "step", *PICKS)
        first = known.join(stored, "phone", "left").withColumn("step", F.coalesce("step", F.lit("start")))
    first = first.select("phone", "seg", *[F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in STATE.split(", "))])
    # Steps that the dialogue does not know begin anew.
    steps = ("choose_dept", "choose_doctor", "choose_date", "choose_slot", "confirm_name")
    known_step = F.when(F.col("step").isin(*steps), F.col("step")).otherwise(F.lit("start"))
    return after.unionByName(first).select("*", F.col("seg").alias("p")).withColumn("step", known_step)


# ----------------------------------------------------------------------------- nodes


def _choose(asked: DataFrame, numbers: DataFrame, options: DataFrame, on: list[str], pick: str, at: str) -> DataFrame:
    """(phone, seg, node, ``at``, ``pick``) of ``asked`` (phone, seg, node, p, ...): the first later message whose number is an option.

    For menus of a bounded length, which are joined whole to each question.  A
    question is compared with the numbers that its segment holds and its
    menu lists; each such (segment, number) is one sequence of positions.
    """
    segment = ["phone", "seg"]
    typed = numbers.select(*segment, "k").distinct()
    # The menu first, where it is keyed by what is known; then only numbers that were typed.
    ways = asked.select(*segment, "node", "p", *on).join(options.select(*on, "k", pick), on).join(typed, [*segment, "k"])
    rows = ways.select(*segment, "k", "p", "node", pick, F.lit(None).cast("bigint").alias("hit")).unionByName(
        numbers.select(*segment, "k", "p", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast(options.schema[pick].dataType).alias(pick),
                       F.col("p").alias("hit"))
    )
    found = first_after(rows, [*segment, "k"], next=F.col("hit")).where("node IS NOT NULL AND next IS NOT NULL")
    chosen = found.groupBy(*segment, "node").agg(F.min(F.struct("next", pick)).alias("c"))
    return chosen.select(*segment, "node", F.col("c.next").alias(at), F.col(f"c.{pick}").alias(pick))


def _choose_listed(asked: DataFrame, numbers: DataFrame, options: DataFrame, on: list[str], pick: str, at: str) -> DataFrame:
    """As :func:`_choose`, for few menus of any length (the doctors of a department).

    No menu is joined to a question: what a segment asks about meets the
    numbers it holds, and only these pairs are looked up.  Each (segment, what
    is asked) is one sequence of the numbers that its menu lists.
    """
    segment = ["phone", "seg"]
    about = asked.select(*segment, *on).distinct()
    listed = about.join(numbers.select(*segment, "k").distinct(), segment).join(options.select(*on, "k", pick), [*on, "k"])
    hits = numbers.join(listed, [*segment, "k"]).select(*segment, *on, "p", F.struct("p", pick).alias("hit"))
    rows = hits.unionByName(asked.select(*segment, *on, "p", "node"), allowMissingColumns=True)
    found = first_after(rows, [*segment, *on], c=F.col("hit")).where("node IS NOT NULL AND c IS NOT NULL")
    return found.select(*segment, "node", F.col("c.p").alias(at), F.col(f"c.{pick}").alias(pick))


def _nodes(rows: DataFrame, entries: DataFrame, menus: dict[str, DataFrame]) -> DataFrame:
    """Every possible dialogue: from its department, or from an entry inside it, to the next one.

    node (position), entry (whether it is the segment's entry), the positions
    q_doctor, q_date, q_slot, q_name, q_next of its answers and of the message
    that opens the next dialogue, the picks, and ``next``, the next node.
    """
    segment = ["phone", "seg"]
    numbers = rows.where("k IS NOT NULL").select(*segment, "k", "p")
    none = {c: F.lit(None).cast(k) for c, k in (x.split() for x in STATE.split(", ")[1:])}
    entry = entries.select(*segment, F.col("p").alias("node"), F.lit(True).alias("entry"), "step", *PICKS)
    said = rows.where("dept IS NOT NULL").select(
        *segment, F.col("p").alias("node"), F.lit(False).alias("entry"), F.lit("choose_doctor").alias("step"),
        *[(F.col(c) if c == "dept" else none[c]).alias(c) for c in PICKS],
    )
    nodes = said.unionByName(entry)
    levels = (
        ("choose_doctor", _choose_listed, ["dept"], "doctor_id", "q_doctor", menus["doctors"].where("open")),
        ("choose_date", _choose, ["doctor_id"], "date", "q_date", menus["dates"].where("open")),
        ("choose_slot", _choose, ["doctor_id", "date"], "slot", "q_slot", menus["slots"]),
    )
    nodes = nodes.withColumn("p", F.when(F.col("step") == "choose_doctor", F.col("node")))
    following = dict(zip(("choose_doctor", "choose_date", "choose_slot"), ("choose_date", "choose_slot", "confirm_name"), strict=True))
    for step, choose, on, pick, at, options in levels:
        # Written, since the next level asks it twice.
        nodes = _written(nodes, f"nodes-{pick}")
        picked = choose(nodes.where("p IS NOT NULL"), numbers, options, on, pick, at)
        found = nodes.drop("p").withColumnRenamed(pick, "_given").join(picked, [*segment, "node"], "left")
        nodes = found.withColumn(pick, F.coalesce(pick, "_given")).drop("_given")
        nodes = nodes.withColumn("p", F.coalesce(at, F.when(F.col("step") == following[step], F.col("node"))))
    at = rows.select(*segment, F.col("p"), "next_name", "next_active", "next_dept")
    named = nodes.join(at.select(*segment, "p", F.col("next_name").alias("q_name")), [*segment, "p"], "left").drop("p")
    # After the name, or from an entry in ``start``, the next message opens a dialogue.
    opens = F.coalesce("q_name", F.when(F.col("step") == "start", F.col("node")))
    opened = named.withColumn("p", opens).join(
        at.select(*segment, "p", F.col("next_active").alias("q_next")), [*segment, "p"], "left"
    ).drop("p")
    waits = F.coalesce("q_next", F.when(F.col("step") == "choose_dept", F.col("node")))
    return opened.withColumn("p", waits).join(
        at.select(*segment, "p", F.col("next_dept").alias("next")), [*segment, "p"], "left"
    ).drop("p")


def reachable(edges: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node) of every node that the heads lead to; ``edges`` (keys, node, next) has one way out of a node.

    Jumps are composed with themselves, so chains of n nodes take log2(n) rounds.
    """
    found = _written(heads.select(*keys, "node").distinct(), "reached")
    jump = _written(edges.where("next IS NOT NULL").select(*keys, "node", "next"), "jump")
    while not jump.isEmpty():
        ahead = found.join(jump, [*keys, "node"]).select(*keys, F.col("next").alias("node"))
        both = _written(found.union(ahead).distinct(), "reached")
        if both.count() == found.count():
            return both
        found = both
        onward = jump.select(*keys, F.col("node").alias("next"), F.col("next").alias("further"))
        jump = _written(jump.join(onward, [*keys, "next"]).select(*keys, "node", F.col("further").alias("next")), "jump")
    return found


# ----------------------------------------------------------------------------- transitions


def _events(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(phone, seg, p, state after it, on_leave): the messages that move a dialogue on."""
    off = leaves.withColumn("on_leave", F.lit(True))
    marked = nodes.join(off, ["doctor_id", "date"], "left").withColumn("on_leave", F.coalesce("on_leave", F.lit(False)))

    def event(at: str, step: str, upto: int, when: Column | None = None) -> Column:
        state = [(F.col(c) if i < upto else F.lit(None).cast(k)).alias(c) for i, (c, k) in enumerate(x.split() for x in STATE.split(", ")[1:])]
        booked = [F.col(c).alias(f"b_{c}") for c in PICKS]
        p = F.col(at) if when is None else F.when(when, F.col(at))
        return F.struct(p.alias("p"), F.lit(step).alias("step"), *state, "on_leave", *booked)

    moves = F.array(
        event("node", "choose_doctor", 1, ~F.col("entry")), event("q_doctor", "choose_date", 2), event("q_date", "choose_slot", 3),
        event("q_slot", "confirm_name", 4), event("q_name", "start", 0), event("q_next", "choose_dept", 0),
    )
    return marked.select("phone", "seg", F.explode(moves).alias("e")).select("phone", "seg", "e.*").where("p IS NOT NULL")


def dialogue_steps(tagged: DataFrame, menus: dict[str, DataFrame], sessions: DataFrame | None = None) -> DataFrame:
    """One transition per message (id, phone, ts, text).

    ``menus`` as :func:`menu_tables` has them; ``sessions`` (phone, step, dept,
    doctor_id, date, slot), one row a phone, is where known phones stand.
    Returns phone, msg_id, ts, intent, from_step, to_step, command, doctor_id,
    date, slot, name (of the booking asked for), reply_kind, and the picks
    that stand after the message: at_dept, at_doctor_id, at_date, at_slot.
    """
    ensure_checkpoint_dir(tagged.sparkSession)
    menus = {**menus, **{name: _written(menus[name], name) for name in ("doctors", "dates")}}
    messages = _written(_messages(tagged), "messages")
    entries = _entries(messages, sessions)
    segment = ["phone", "seg"]
    depts = menus["departments"]
    plain = messages.select(*segment, "p", "k", "name", (F.col("intent") == INTENT_OTHER).alias("active")).join(depts, "k", "left")
    blank = {"k": "int", "name": "string", "dept": "string"}
    begin = entries.select(*segment, "p", F.lit(False).alias("active"), *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    rows = first_after(
        plain.unionByName(begin), segment,
        next_name=F.when(F.col("name").isNotNull(), F.col("p")),
        next_active=F.when(F.col("active"), F.col("p")),
        next_dept=F.when(F.col("dept").isNotNull(), F.col("p")),
    )
    rows = _written(rows, "rows")
    nodes = _written(_nodes(rows, entries, menus), "nodes")
    heads = nodes.where("entry AND next IS NOT NULL").select(*segment, F.col("next").alias("node"))
    real = reachable(nodes.where("NOT entry"), heads, segment)
    happened = nodes.where("NOT entry").join(real, [*segment, "node"], "left_semi").unionByName(nodes.where("entry"))
    events = _events(happened, menus["leaves"])

    moved = messages.join(events.select(*segment, "p", F.struct(*[c for c in events.columns if c not in (*segment, "p")]).alias("e")),
                          [*segment, "p"], "left")
    state = [c.split()[0] for c in STATE.split(", ")]
    marks = moved.select(*messages.columns, "e", F.when(F.col("e").isNotNull(), F.struct("p", *[F.col(f"e.{c}") for c in state])).alias("now"))
    starts = entries.select(*segment, "p", F.struct("p", *state).alias("now"))
    stood = last_before(marks.unionByName(starts, allowMissingColumns=True), segment, was=F.col("now")).where("id IS NOT NULL")
    return _transitions(stood, menus)


def _transitions(stood: DataFrame, menus: dict[str, DataFrame]) -> DataFrame:
    """What each message does, from where its phone stood and the event that it is."""
    doctors = menus["doctors"].select(F.col("dept").alias("m_dept"), F.col("k").alias("m_k"), F.lit(True).alias("listed_doctor"))
    dates = menus["dates"].select(F.col("doctor_id").alias("n_doctor"), F.col("k").alias("n_k"), F.lit(True).alias("listed_date"))
    step, kind = F.col("was.step"), F.col("intent")
    stays = (kind == INTENT_OTHER) & F.col("e").isNull()
    seen = stood.join(
        doctors, stays & (step == "choose_doctor") & (F.col("was.dept") == F.col("m_dept")) & (F.col("k") == F.col("m_k")), "left"
    ).join(
        dates, stays & (step == "choose_date") & (F.col("was.doctor_id") == F.col("n_doctor")) & (F.col("k") == F.col("n_k")), "left"
    )
    books = (F.col("e.step") == "start") & ~F.col("e.on_leave")
    replies = {"choose_dept": "departments", "choose_doctor": "doctors", "choose_date": "dates", "choose_slot": "slots", "confirm_name": "ask_name"}
    moved = reduce(lambda c, x: c.when(F.col("e.step") == x[0], F.lit(x[1])), replies.items(), F.when(books, "book"))
    reply = (
        F.when(kind == INTENT_CANCEL, "cancel").when(kind == INTENT_STATUS, "status").when(kind == INTENT_GREET, "departments")
        .when(F.col("e").isNotNull(), moved.otherwise("on_leave"))
        .when(step == "confirm_name", "ask_name").when(F.col("listed_doctor"), "no_dates").when(F.col("listed_date"), "no_slots")
        .otherwise("reprompt")
    )

    def after(c: str) -> Column:
        at_reset = F.lit("choose_dept") if c == "step" else F.lit(None)
        clear = F.lit("start") if c == "step" else F.lit(None)
        return F.when(kind == INTENT_CANCEL, clear).when(kind == INTENT_GREET, at_reset).when(
            F.col("e").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(f"was.{c}"))

    command = F.when(kind.isin(INTENT_CANCEL, INTENT_STATUS), kind).when(books, "book")
    return seen.select(
        "phone", F.col("id").alias("msg_id"), "ts", "intent", step.alias("from_step"), after("step").alias("to_step"),
        command.alias("command"), *[F.when(books, F.col(f"e.b_{c}")).alias(c) for c in PICKS[1:]],
        F.when(books, F.col("name")).alias("name"), reply.alias("reply_kind"), *[after(c).alias(f"at_{c}") for c in PICKS],
    )


def sessions_after(transitions: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Where each phone stands after the transitions (T-4 in batch form): phone, step, dept, doctor_id, date, slot, updated_at.

    The last transition of a phone counts; phones without one stand where they stood.
    """
    last = F.max(F.struct("ts", "msg_id", F.col("to_step").alias("step"), *[F.col(f"at_{c}").alias(c) for c in PICKS])).alias("s")
    moved = transitions.groupBy("phone").agg(last).select("phone", "s.step", *[f"s.{c}" for c in PICKS], F.col("s.ts").alias("updated_at"))
    if sessions is None:
        return moved
    return moved.unionByName(sessions.select(moved.columns).join(moved, "phone", "left_anti"))
