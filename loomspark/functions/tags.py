"""Work-type tags of a session from its messages and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tags in their order, and the rules' words (ASCII word boundaries, or Chinese words).
TAGS = ("bugfix", "refactoring", "feature-dev", "testing", "docs", "git-ops", "build-deploy", "exploration", "planning")
USER_WORDS = {
    "bugfix": ("fix|bug|error|crash|exception|fail(?:ed|ure)?", "修复|错误|报错|崩溃|异常"),
    "refactoring": ("refactor|rename|simplify|clean up|cleanup", "重构|重命名|简化|清理"),
    "feature-dev": ("add|create|implement|new|support|build", "新增|创建|实现|增加|开发|支持"),
    "docs": ("document|documentation|readme|docs?", "文档|说明"),
}
TESTING = r"pytest|vitest|jest|mocha|pnpm\s+test|npm\s+test|yarn\s+test"
GIT = r"git\s+(?:push|commit|merge|branch|checkout|switch|rebase|tag)"
BUILD = r"(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?build|docker|pm2|deploy|vercel|netlify"
READ = "read|grep|glob|websearch|web_search|search|find|rg"
EDIT = "edit|write|apply_patch|patch|multiedit|notebookedit"
PLAN = "enterplanmode|taskcreate|update_plan|plan"
DOC_PATH = r"(?i)\.(?:md|mdx|txt|rst|adoc)$"


def has_word(text: Column, words: str, other: str = "") -> Column:
    """Whole words by ASCII boundaries, any case; other alternatives anywhere."""
    pattern = f"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])" + (f"|{other}" if other else "")
    return text.rlike(pattern)


def session_tags(messages: DataFrame) -> DataFrame:
    """(ref, tags) from messages(ref, role, text, is_plan, tool_name, payload, edited_path); tags in their fixed order."""
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    user, tool = F.when(F.col("role") == "user", F.col("text")), F.col("tool_name")
    found = {tag: yes(has_word(user, *words)) for tag, words in USER_WORDS.items()}
    found["docs"] = yes(has_word(user, *USER_WORDS["docs"])) | yes(F.col("edited_path").rlike(DOC_PATH))
    found |= {"testing": yes(has_word(F.col("payload"), TESTING)), "git-ops": yes(has_word(F.col("payload"), GIT)), "build-deploy": yes(has_word(F.col("payload"), BUILD)), "planning": yes(F.col("is_plan")) | yes(has_word(tool, PLAN))}
    reads, edits = F.count_if(has_word(tool, READ)), F.count_if(has_word(tool, EDIT))
    found["exploration"] = (reads >= 3) & (edits <= 1)
    tags = F.concat(*[F.when(found[t], F.array(F.lit(t))).otherwise(F.array().cast("array<string>")) for t in TAGS])
    return messages.groupBy("ref").agg(tags.alias("tags"))
