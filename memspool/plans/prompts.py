"""Prompt texts, versioned: what a reply means depends on them.  Each ends in the JSON shape that is expected."""

SYSTEM = "You keep a long-term memory of one user. You read conversations and report what is worth remembering. Reply exactly in the format that is asked for."

EXTRACT_VERSION = "extract-1"
EXTRACT = """Conversation {conv_id}, held on {conv_date}, follows. Each line starts with the id of its turn.

{transcript}

List what it says about the user that will matter later. Sort it into identity (who they are, lasting preferences),
episodes (things that happened) and threads (work or questions that are open). Write each fact as one short
sentence of its own. Copy the decisive words as a quote. Give dates only if they are stated.
JSON: {{"identity": [{{"text": "...", "granularity": "summary|episode|detail", "salience": 0.0, "confidence": "stated|inferred",
"tags": ["..."], "valid_from": "YYYY-MM-DD or null", "valid_until": "YYYY-MM-DD or null", "quote": "... or null"}}], "episodes": [], "threads": []}}"""

RESOLVE_VERSION = "resolve-1"
RESOLVE = """Numbered facts:

{numbered}

Which say the same, and which contradict each other because something changed?
JSON: {{"duplicates": [[keep, drop]], "contradictions": [[older, newer]]}} with the numbers above; empty lists if none."""

MERGE_VERSION = "merge-1"
MERGE = """Facts in memory:

{existing}

New facts:

{new}

Which new facts repeat one in memory, and which replace one that no longer holds?
JSON: {{"duplicates": [[existing, new]], "contradictions": [[existing, new]]}} with the numbers above; empty lists if none."""

HIERARCHY_VERSION = "hierarchy-1"
HIERARCHY = """Numbered episodes:

{numbered}

Group those that belong to one story, and sum up each group in a sentence.
JSON: {{"groups": [{{"summary": "...", "members": [0, 1]}}]}}"""

STYLE_VERSION = "style-1"
STYLE = """Messages that a user wrote:

{messages}

Describe in a few lines of Markdown how this user likes to communicate: language, tone, length, format."""

STYLE_MERGE_VERSION = "style-merge-1"
STYLE_MERGE = """Notes on how a user likes to communicate, each from another part of what they wrote:

{messages}

Make one description of them, in a few lines of Markdown: language, tone, length, format."""

ANSWER_SUFFIX = "\nUse nothing but the memory above to answer what is asked, in one short sentence."
