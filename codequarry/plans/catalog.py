"""Catalogue tables: question categories, rewrite levels, prompt templates.

The strings below are FIXED VALUES: they must equal the original
benchmark's wording for prompts (and therefore model outputs) to be
comparable. They are stated plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# FIXED VALUES — question categories (name, optional context turn, question
# instruction) and the answer instruction.
# ---------------------------------------------------------------------------
CATEGORIES = [
    "General",
    "Functionality",
    "Purpose",
    "Property",
    "Workflow",
    "Edge Cases",
    "Performance and Scalability",
    "Control Flow",
    "OOP Concepts",
]
PRE_PROMPTS = [
    None,
    None,
    None,
    None,
    None,
    "Explain the concept of edge cases in programming.",
    "Explain the concepts of performance and scalability in programming.",
    "Explain the concept of control flow in programming.",
    "List and explain key concepts in object-oriented programming (OOP).",
]
QUESTION_PROMPTS = [
    "In one sentence, generate an answerable question based on this code. Only output the question.",
    "Functionality provides a definition of the range of functions that the subject and/or its interface can perform. In one sentence, generate an answerable question related to functionality based on this code. Only output the question.",
    "Purpose explains the reason why the subject is provided or the design rationale of the subject. In one sentence, generate an answerable question related to purpose based on this code. Only output the question.",
    "Property declares properties of the subject, such as pre-conditions and post-conditions of a method or some statements. In one sentence, generate an answerable question related to property based on this code. Only output the question.",
    "Workflow describes how the subject is done, which means implementation details like the design or the workflow of the subject. In one sentence, generate an answerable question related to workflow based on this code. Only output the question.",
    "In one sentence, generate an answerable question related to edge cases based on this code. Only output the question.",
    "In one sentence, generate an answerable question related to performance and scalability based on this code. Only output the question.",
    "In one sentence, generate an answerable question related to control flow based on this code. Only output the question.",
    "In one sentence, generate an answerable question related to object-oriented programming (OOP) concepts based on this code. Only output the question.",
]
ANSWER_PROMPT = "In one sentence, provide the correct answer to this question based on the code. Only output the answer."

# ---------------------------------------------------------------------------
# FIXED VALUES — follow-up question generation (n questions per category,
# "another" prompts, extractive span mode).
# ---------------------------------------------------------------------------
FOLLOWUP_CATEGORIES = ["general", "why", "edge cases", "functionality", "extractive"]
FOLLOWUP_FIRST_PROMPTS = [
    "In one sentence, generate an answerable question based on this code. Only output the question.",
    'In one sentence, generate an answerable "why" question based on this code. Only output the question.',
    "In one sentence, generate an answerable question about edge cases based on this code. Only output the question.",
    "In one sentence, generate an answerable question about functionality based on this code. Only output the question.",
    "In one sentence, generate an extractive question that can be answered with a one-line span extracted directly from this code. Only output the question.",
]
FOLLOWUP_NEXT_PROMPTS = [
    "In one sentence, generate another answerable question based on the code. Only output the question.",
    'In one sentence, generate another answerable "why" question based on the code. Only output the question.',
    "In one sentence, generate another answerable question about edge cases based on the code. Only output the question.",
    "In one sentence, generate another answerable question about functionality based on the code. Only output the question.",
    "In one sentence, generate another extractive question that can be answered with a one-line span extracted directly from the code. Only output the question.",
]
FOLLOWUP_EXTRACTIVE_CONTEXT = "What is extractive question answering?"
FOLLOWUP_ANSWER_PROMPT = "In one sentence, generate the correct answer to this question based on the code. Only output the answer."
FOLLOWUP_SPAN_PROMPT = "Provide a one-line span extracted directly from the code which contains the correct answer to this question. Only output the answer span."
FOLLOWUP_N = 3

# ---------------------------------------------------------------------------
# FIXED VALUES — primary (model) rewrite levels and their instructions.
# ---------------------------------------------------------------------------
REFACTOR_PROMPT = (
    "Without renaming any existing variables/functions/classes, alter and/or refactor this code "
    "without changing its overall behavior. For example, this can be done by reordering certain "
    "statements that do not depend on one another, or wrapping reused statements in functions, "
    "for example. Only output the full block of code above with your modifications, without any "
    "additional outputs."
)
DEAD_CODE_PROMPT = (
    "Without modifying any existing lines of code, add blocks of dead code that are never executed "
    "or have no effect on this program's behavior. For example, this can include unused variables, "
    "functions, or control structures. Try to hide them by giving them names that make them seem "
    "like legitimate live code. Only output the full block of code above with your modifications, "
    "without any additional outputs."
)
PRIMARY_LEVELS = ["None", "Refactor", "Dead Code", "Refactor and Dead Code"]
# Older five-level variant (the first two rewrites done by parsing).
PRIMARY_LEVELS_V1 = ["None", "Undocument", "Rename", "Refactor", "Dead Code"]

# ---------------------------------------------------------------------------
# FIXED VALUES — secondary (parser-based) rewrite levels.
# ---------------------------------------------------------------------------
SECONDARY_LEVELS = ["None", "Undocument", "Rename", "Undocument and Rename"]

# ---------------------------------------------------------------------------
# FIXED VALUES — answering / summarising templates.  "{prompt}", "{question}",
# "{code}", "{summary}", "{fewshot_examples}", "{input}", "{output}" are
# the slots.
# ---------------------------------------------------------------------------
QA_TEMPLATE_QUESTION_ONLY = (
    "\nAnswer the question below. Only output the answer to the question, nothing else. "
    "Limit your answer to one sentence.\n\nQuestion: {question}\n\n\nAnswer in one sentence:"
)
QA_TEMPLATE_WITH_CODE = (
    "\nGiven the code below, answer the question that follows it. Only output the answer to the "
    "question, nothing else. Limit your answer to one sentence.\n\nCode:\n```python\n{prompt}\n```"
    "\n\nQuestion: {question}\n\n\nAnswer in one sentence:"
)
CODEGEN_TEMPLATE = (
    "Generate code to complete the following Python function based on its provided summary. "
    "Only output the code block.\n```python\n{prompt}\n```\n\nSummary: \n{summary}"
)
SUMMARIZE_TEMPLATE = "Write a one sentence summary of the following Python code:\n```python\n{code}\n```"
FEWSHOT_SUMMARIZE_TEMPLATE = (
    "Write a one sentence summary of the Python code.\n\nHere are some examples:\n"
    "{fewshot_examples}\n\nYour turn!\n\nInput: \n```python\n{code}\n```\nOutput:"
)
FEWSHOT_EXAMPLE_TEMPLATE = "Input:\n```python\n{input}\n```\nOutput: {output}"

# FIXED VALUES — one-shot edge-case prompt with fenced code tags.
EDGE_CASE_TEMPLATE = (
    "<start of code> {code}\n\n<end of code>\n\n\nGiven the above code enclosed within <start of code> "
    "and <end of code> tags, generate 3 questions based on it on possible edge cases that could be "
    "encountered. Then, answer the questions."
)

# FIXED VALUES — default few-shot pairs (code -> one-sentence summary).
DEFAULT_FEWSHOT = [
    (
        "def get_aa_info(code):\n    letter = 'X'\n    # Try to get content from PDBE.\n    url_string = 'http://www.ebi.ac.uk/pdbe-srv/pdbechem/chemicalCompound/show/{0}'.format(code)\n    r = requests.get(url_string)\n    # Raise error if content not obtained.\n    if not r.ok:\n        raise IOError(\"Could not get to url {0}\".format(url_string))\n\n    # Parse r.text in an ugly way to get the required information.\n    description = r.text.split('<h3>Molecule name')[1].split('</tr>')[0]\n    description = description.strip().split('\\n')[3].strip()[:255]\n    modified = r.text.split(\"<h3>Standard parent \")[1].split('</tr>')[0]\n    modified = modified.replace(\" \", \"\").replace('\\n', '').split('<')[-3].split('>')[-1]\n    if modified == \"NotAssigned\":\n        modified = None\n    # Add the required information to a dictionary which can then be passed to add_amino_acid_to_json.\n    aa_dict = {'code': code, 'description': description, 'modified': modified, 'letter': letter}\n    return aa_dict",
        "Get dictionary of information relating to a new amino acid code not currently in the database.",
    ),
    (
        "def _build_filters(_filters):\n    root = utils.NestedDict({})\n    for _filter in _filters:\n        operation = None\n        for operation, token in SPLIT_TOKENS:\n            # split \"some.key=value\" into [\"some.key\", \"value\"]\n            top_parts = _filter.split(token, 1)\n            if len(top_parts) == 2:\n                break\n        else:\n            raise exceptions.CLIAbort('Failed to find valid operation for: %s'\n                                      % _filter)\n\n        key, value = top_parts\n        current = root\n        # split \"some.key\" into [\"some\", \"key\"]\n        parts = [part.strip() for part in key.split('.')]\n\n        # Actually drill down and add the filter\n        for part in parts[:-1]:\n            current = current[part]\n\n        if operation == 'eq':\n            current[parts[-1]] = utils.query_filter(value.strip())\n        elif operation == 'in':\n            current[parts[-1]] = {\n                'operation': 'in',\n                'options': [{\n                    'name': 'data',\n                    'value': [p.strip() for p in value.split(',')],\n                }],\n            }\n\n    return root.to_dict()",
        "Builds filters using the filter options passed into the CLI.",
    ),
    (
        "def get_quantities(self, quantities, filters=None, native_filters=None, return_iterator=False):\n        quantities = self._preprocess_requested_quantities(quantities)\n        filters = self._preprocess_filters(filters)\n        native_filters = self._preprocess_native_filters(native_filters)\n\n        it = self._get_quantities_iter(quantities, filters, native_filters)\n\n        if return_iterator:\n            return it\n\n        data_all = defaultdict(list)\n        for data in it:\n            for q in quantities:\n                data_all[q].append(data[q])\n        return {q: concatenate_1d(data_all[q]) for q in quantities}",
        "Fetch quantities from this catalog.",
    ),
    (
        "def wind_shear(shear: str, unit_alt: str = 'ft', unit_wind: str = 'kt', spoken: bool = False) -> str:\n    if not shear or 'WS' not in shear or '/' not in shear:\n        return ''\n    shear = shear[2:].rstrip(unit_wind.upper()).split('/')  # type: ignore\n    wdir = core.spoken_number(shear[1][:3]) if spoken else shear[1][:3]\n    return f'Wind shear {int(shear[0])*100}{unit_alt} from {wdir} at {shear[1][3:]}{unit_wind}'",
        "Translate wind shear into a readable string",
    ),
    (
        "def creates_cycle(connections, test):\n    i, o = test\n    if i == o:\n        return True\n\n    visited = {o}\n    while True:\n        num_added = 0\n        for a, b in connections:\n            if a in visited and b not in visited:\n                if b == i:\n                    return True\n\n                visited.add(b)\n                num_added += 1\n\n        if num_added == 0:\n            return False",
        "Returns true if the addition of the test connection would create a cycle assuming that no cycle already exists in the graph represented by connections.",
    ),
]

# FIXED VALUES — entry-point naming defaults.
ENTRY_STOP_WORDS = ["in", "of", "a", "to", "and", "for", "with", "that"]
ENTRY_DELIMITERS = ["`", "'"]
ENTRY_FIRST_NWORDS = 4

# FIXED VALUES — corpus sampling and alias seed of the original scripts.
DEFAULT_SEED = 11797
DEFAULT_SAMPLE_N = 1000
DEFAULT_LOAD_SEED = 14

# FIXED VALUES — answering defaults (batch of prompts, samples per prompt).
DEFAULT_BATCH_SIZE = 8
DEFAULT_N_SAMPLES = 5
DEFAULT_SAVE_FREQ = 100


# ---------------------------------------------------------------------------
# Catalogue DataFrames. All are tiny, fixed-size dimension tables: safe to
# broadcast (their size does not grow with the data).
# ---------------------------------------------------------------------------

def categories_df(spark: SparkSession) -> DataFrame:
    rows = [(i, c, p, q) for i, (c, p, q) in enumerate(zip(CATEGORIES, PRE_PROMPTS, QUESTION_PROMPTS))]
    return spark.createDataFrame(
        rows, "category_no int, category string, pre_prompt string, prompt string")


def primary_levels_df(spark: SparkSession, double_refactor: bool = False) -> DataFrame:
    """Primary levels as a chain: (level, level_no, step, prompt, reads_level).

    ``reads_level`` names the level whose output feeds this one (NULL = the
    original code).  The combined level applies the dead-code prompt to the
    refactored code; ``double_refactor=True`` reproduces the original
    script, which sent the refactor prompt a second time.
    """
    second = REFACTOR_PROMPT if double_refactor else DEAD_CODE_PROMPT
    rows = [
        ("None", 0, 0, None, None),
        ("Refactor", 1, 1, REFACTOR_PROMPT, None),
        ("Dead Code", 2, 1, DEAD_CODE_PROMPT, None),
        ("Refactor and Dead Code", 3, 2, second, "Refactor"),
    ]
    return spark.createDataFrame(
        rows, "level string, level_no int, step int, prompt string, reads_level string")


def secondary_levels_df(spark: SparkSession) -> DataFrame:
    rows = [("None", 0, False, False), ("Undocument", 1, True, False),
            ("Rename", 2, False, True), ("Undocument and Rename", 3, True, True)]
    return spark.createDataFrame(
        rows, "level string, level_no int, undocument boolean, rename boolean")


def fewshot_df(spark: SparkSession) -> DataFrame:
    rows = [(i, inp, out) for i, (inp, out) in enumerate(DEFAULT_FEWSHOT)]
    return spark.createDataFrame(rows, "ex_no int, input string, output string")
