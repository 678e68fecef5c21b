"""A learning platform as source and target: what to ask of it, and how answers become tables. The transport is the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (function of the platform, parameters) -> its answer, decoded. It sends the token and checks the connection.
Transport = Callable[[str, Mapping[str, Any]], Any]


def call(send: Transport, function: str, params: Mapping[str, Any]) -> Any:
    """The platform's answer; one that reports an error raises."""
    found = send(function, params)
    if isinstance(found, Mapping) and ("exception" in found or "errorcode" in found):
        raise RuntimeError(str(found.get("message", found)))
    return found


def assignments(spark: SparkSession, send: Transport, course: int) -> DataFrame:
    """(assignment_id, name, course_id) of a course: a page of the platform, so it is small."""
    found = call(send, "mod_assign_get_assignments", {"courseids[0]": course})
    rows = [(int(a["id"]), a.get("name", ""), int(c["id"])) for c in found.get("courses", []) for a in c.get("assignments", [])]
    return spark.createDataFrame(rows, "assignment_id long, name string, course_id long")


def submissions(spark: SparkSession, send: Transport, assignment: int) -> DataFrame:
    """(assignment_id, user_id, status, attempt, text): texts as typed into the platform, tags and entities resolved."""
    from gradeloom.functions.text import strip_invisible

    found = call(send, "mod_assign_get_submissions", {"assignmentids[0]": assignment})
    rows = []
    for a in found.get("assignments", []):
        for s in a.get("submissions", []):
            fields = [f.get("text", "") for p in s.get("plugins", []) for f in p.get("editorfields", [])]
            rows.append((int(a["assignmentid"]), int(s["userid"]), s.get("status", ""), int(s.get("attemptnumber", 0)), "\n".join(filter(None, fields))))
    d = spark.createDataFrame(rows, "assignment_id long, user_id long, status string, attempt int, text string")
    return d.withColumn("text", strip_invisible(F.col("text")))


def push_grades(send: Transport, grades: DataFrame, assignment: int, most: int = 10_000) -> list[dict[str, Any]]:
    """Sends grades(user_id, grade, feedback, approved) one by one, in order of user_id; what isn't approved stops it before anything is sent.

    Returns what was sent and how it went: a failure is noted and the others go on. Pushing again sends the same grades.
    """
    rows = grades.select("user_id", F.col("grade").cast("double").alias("grade"), F.coalesce("feedback", F.lit("")).alias("feedback"), F.coalesce("approved", F.lit(False)).alias("approved")).orderBy("user_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} grades")
    if not all(r.approved and r.grade is not None for r in rows):
        raise PermissionError("a teacher must approve every grade before it is sent")
    out = []
    for r in rows:
        # fixed values: the names of the platform's parameters
        params = {
            "assignmentid": assignment, "userid": r.user_id, "grade": r.grade, "attemptnumber": -1, "addattempt": 0, "workflowstate": "released", "applytoall": 0,
            "plugindata[assignfeedbackcomments_editor][text]": r.feedback, "plugindata[assignfeedbackcomments_editor][format]": 1,
        }
        try:
            call(send, "mod_assign_save_grade", params)
            out.append({"user_id": r.user_id, "ok": True, "error": ""})
        except (RuntimeError, OSError, json.JSONDecodeError) as e:
            out.append({"user_id": r.user_id, "ok": False, "error": str(e)})
    return out
