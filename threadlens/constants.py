"""Fixed values.

Everything in this module must stay byte-for-byte as written: the label domains
decide which model answers are accepted, and the texts are rendered into every
prompt.  They are stated here once, in their natural order, and used everywhere
else by name.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: label domains
# ---------------------------------------------------------------------------
ALLOWED_ACTS = [
    "Accept",
    "Apologize",
    "Behave",
    "Claim",
    "Congratulate",
    "Desire (Irrealis)",
    "Desire",
    "Direct",
    "Elaborate",
    "Greet",
    "Inform",
    "Inquire",
    "Invite",
    "Manage",
    "React",
    "Reject",
    "Repair",
    "Request",
    "Thank",
]
ALLOWED_POLITENESS = ["+P", "+N", "-P", "-N"]
ALLOWED_META = ["non-bona fide", "reported"]
ALLOWED_NON_BONA_FIDE = ["True", "False"]

# ---------------------------------------------------------------------------
# FIXED VALUES: response tags, JSON keys, status markers, seeds
# ---------------------------------------------------------------------------
ANNOT_OPEN = "[ANNOT]"
ANNOT_CLOSE = "[/ANNOT]"
REASON_OPEN = "[REASON]"
REASON_CLOSE = "[/REASON]"

KEY_ACT = "act"
KEY_POLITENESS = "politeness"
KEY_META = "self/reported"
KEY_NBF = "non-bona fide"

MIN_REASON_CHARS = 20

STATUS_FAILED = "__FAILED__"
STATUS_FLAGGED = "__FLAGGED__"

BASE_SEED = 93187
DEFAULT_MAX_TRIES = 20
DEBUG_ROWS = 20

# category values of the threaded layout
CAT_ORIGINAL_POST = "Original post"
CAT_COMMENT = "Comment"
NO_TARGET = "N/A"

LAYOUT_THREADED = "threaded"
LAYOUT_SEQUENTIAL = "sequential"

# ---------------------------------------------------------------------------
# FIXED VALUES: per-corpus background narratives (sequential, threaded)
# ---------------------------------------------------------------------------
BACKGROUND_SEQUENTIAL = (
    "**Background Context**: A Reddit user (JuvieThrowaw) shares that as a teenager "
    "they fatally shot their mother's abusive boyfriend after he harmed their sister, "
    "served juvenile time, and now is getting his life back on track. The user answers "
    "questions about how they feel about what happened, how it affected their "
    "relationship with their mother, sister, and stepfather, and what they are doing "
    "now."
)
BACKGROUND_THREADED = (
    "**Background Context**: A Reddit user (CallSign_Fjor) posts in r/gaming that "
    "their friends lost interest in finishing Terraria and other games with them "
    "because the user had progressed farther, even though the user avoided using "
    "end-game gear and shared resources. The post asks why some players feel "
    "'invalidated' by someone else's faster progression."
)

# ---------------------------------------------------------------------------
# FIXED VALUES: user-prompt blocks
# ---------------------------------------------------------------------------
TASK_INSTRUCTION = (
    "**Task Instruction**: You are given a single utterance from Reddit. Please read the background and surrounding context carefully, "
    "then decide on the communicative act of the target utterance, its politeness value (if clearly expressed), "
    "and any applicable meta-acts. Use the CMC Communicative Act Taxonomy developed by Herring, Das, and Penumarthy (2005), "
    "revised in 2024 by Herring and Ge-Stadnyk, to guide your annotation. For politeness and impoliteness, refer to Herring (1994) "
    "and Culpeper's (2011a) frameworks. For meta-acts such as reported perspective and non-bona fide, follow the definitions included in the taxonomy."
)
REASONING_BLOCK = (
    "\n**Reasoning**: Provide step-by-step analysis inside [REASON]…[/REASON] before your final answer. "
    "Follow the annotation procedure:"
    "1. **Read the target utterance carefully** in relation to the supplied context, including background story, preceding and following messages. "
    "2. **Pay close attention to the speaker's intent in context, not only the surface form of the message** - what is the primary communicative goal? "
    "3. **For the two meta-act codes:** "
    "- **Check whether there is reported perspective in the utterance.** This is often found in an embedded clause. If there is reported content and it is the most important information in the utterance in the context in which it appears, code the meta-act as \"reported\" and focus on that part when assigning an act code later. Otherwise, do not assign \"reported\" and instead focus on the main proposition when assigning the speech act later. "
    "- **Check whether the utterance is bona fide or non-bona fide.** If non-bona fide, assign the meta-act code as \"Non-bona fide\" and code the utterance for speech act as if it were sincere. "
    "4. 4. **Consider the 2-3 most plausible act options**, and then select the primary communicative function based on the part of the utterance identified in step 3. "
    "5. **Code for politeness/impoliteness** only if clearly expressed or inferrable from the context (not neutral interactions). "
    "Think aloud step-by-step, and select the primary communicative function, politeness (if strong enough), and meta-acts (and subtype) when appropriate."
)
# appended to the reasoning block when the model tag (name before the first '-') is o3
REASONING_O3_EXTRA = (
    "\nIf you used hidden or internal reasoning anywhere, copy **all** of that "
    "reasoning verbatim inside the same [REASON]…[/REASON] block."
)
FORMAT_BLOCK = (
    "\n**Output Format**: First provide your step-by-step reasoning inside [REASON]…[/REASON], "
    "then return the annotation as one JSON object wrapped EXACTLY like:\n"
    '[ANNOT]{"act":"<ACT>","politeness":"<POL>","self/reported":"< META >","non-bona fide":"<NON_BONA_FIDE>"}[/ANNOT]'
)
THREAD_STARTERS_HEADER = "Thread starter messages:"

# ---------------------------------------------------------------------------
# FIXED VALUES: generation backends (name-prefix routing and sampling settings)
# columns: backend, temperature, top_p, max_tokens, sends_seed, flat_prompt
# ---------------------------------------------------------------------------
BACKEND_PARAMS = [
    ("openai", 0.6, 0.9, 10240, True, False),
    ("anthropic", 0.0, 1.0, 10240, False, False),
    ("gemini", 0.0, 1.0, 10240, False, True),
    ("llama", 0.6, 0.9, 1024, True, False),
]
# (prefix, backend); 'llama' is matched anywhere in the lower-cased name
BACKEND_PREFIXES = [("gpt-", "openai"), ("o3-", "openai"), ("claude-", "anthropic"), ("gemini-", "gemini")]
BACKEND_SUBSTRING = ("llama", "llama")

# error text that marks a content-policy refusal (terminal, not retried)
POLICY_WORDS = ["policy", "safety"]

# output columns appended to the utterance table, in order
OUTPUT_COLUMNS = [
    "annotation_act",
    "annotation_politeness",
    "annotation_meta",
    "annotation_NBF",
    "annotation_reasoning",
    "raw_prompt",
    "raw_response",
    "annotation_seed",
    "annotation_timestamp",
]
