"""Vocabularies and patterns.

Fixed values: they must equal those of existing graphs, so that the same text
gives the same nodes, edges and classes.
"""

SECTION_HEADINGS = [
    "abstract", "introduction", "related work", "background", "method(ology)?", "approach", "system", "experiment(s)?",
    "result(s)?", "evaluation", "discussion", "conclusion(s)?", "future work", "references?", "bibliography", "appendix", "supplementary",
]

METHODS = [
    "Transformer", "BERT", "GPT", "GraphRAG", "RAG", "ResNet", "LSTM", "CNN", "SVM", "Random Forest", "Neural Network",
    "Self-Attention", "Multi-Head Attention",
]
DATASETS = ["ImageNet", "CIFAR-10", "CIFAR-100", "MNIST", "COCO", "SQuAD", "GLUE", "SuperGLUE", "WMT14", "PubMed"]
TASKS = [
    "machine translation", "question answering", "image classification", "object detection", "semantic search",
    "document retrieval", "named entity recognition", "text classification", "summarization", "information extraction",
]
METRICS = [
    "accuracy", "precision", "recall", "F1", "F1-score", "BLEU", "ROUGE", "AUC", "perplexity", "latency", "throughput", "MRR", "NDCG",
]

STOPWORD_NAMES = [
    "a", "an", "the", "this", "that", "these", "those", "it", "its", "we", "our", "ours", "us", "they", "their", "theirs",
    "them", "he", "she", "his", "her", "i", "my", "you", "your", "all", "both", "each", "every", "any", "some", "such",
    "same", "other", "another", "one", "two", "three", "first", "second", "no", "not", "only", "also", "then", "than",
    "there", "here", "which", "who", "whom", "whose", "what", "when", "where", "how", "and", "or", "but", "if", "so", "as",
    "of", "in", "on", "for", "to", "by", "with", "from", "at", "is", "are", "was", "were", "be", "been", "being", "has",
    "have", "had", "do", "does", "did", "can", "could", "will", "would", "may", "might", "must", "should", "proposed",
    "existing", "previous", "recent", "new", "novel", "several", "many", "most", "more", "less", "very", "however",
]
DANGLING_TAILS = [
    "a", "an", "the", "of", "in", "on", "for", "to", "by", "with", "from", "at", "and", "or", "but", "as", "that", "which",
    "is", "are", "was", "were", "be", "been", "than", "then", "into", "over", "under", "between", "through", "during", "per",
]
INTERIOR_CONNECTORS = [
    "the", "a", "an", "on", "in", "at", "and", "or", "with", "from", "by", "to", "that", "which", "we", "our", "this",
]
CLAUSE_MARKERS = (
    r"(?i)\b(?:is|are|was|were|be|been|being|has|have|had|does|do|did|can|could|will|would|may|might|must|should|enables?|denotes?|"
    r"shows?|allows?|requires?|provides?|contains?|includes?|consists?|employs?|leverages?|that|which|whose|whereas|while|because|"
    r"therefore|thus|hence)\b"
)
MAX_NAME_WORDS = 6

METHOD_CAPTURES = [
    r"\b(?i:propose|introduce|present|use|using|develop)\s+(?i:a|an|the)?\s*([A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,4})\s+(?i:model|method|architecture|framework|algorithm|approach)\b",
    r"\b([A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,4})\s+(?i:model|method|architecture|framework|algorithm|approach)\b",
]
DATASET_CAPTURES = [
    r"\b(?i:on|using|with|from)\s+([A-Z][A-Za-z0-9-]*(?:[- ][A-Za-z0-9]+){0,4})\s+(?i:dataset|corpus|benchmark)\b",
    r"\b([A-Z][A-Za-z0-9-]*(?:[- ][A-Za-z0-9]+){0,4})\s+(?i:dataset|corpus|benchmark)\b",
]
TASK_CAPTURES = [
    r"\b(?i:for|on|solve|solves|address|addresses)\s+([a-z][a-z -]{3,40}?)\s+(?i:task|problem)\b",
    r"\b([a-z][a-z -]{3,40}?)\s+(?i:task|problem)\b",
]
METRIC_CAPTURES = [
    r"\b(?i:measured by|reports?|achieves?|obtains?|yields?)\s+(?i:a|an|the)?\s*([A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*){0,2}\s+(?i:score|rate|error))\b",
]
CLAIMS = [
    r"\bwe\s+(show|demonstrate|prove|find|observe|claim|conclude)\b",
    r"\bresults?\s+(show|demonstrate|indicate|suggest)\b",
    r"\b(outperform|improve|achieve|reduce|increase)s?\b",
    r"\bstate[- ]of[- ]the[- ]art\b",
]
EXPERIMENTS = [r"\bexperiment(s|al)?\b", r"\bevaluat(e|ed|ion|ing)\b", r"\bablation\b", r"\bbenchmark\b", r"\bbaseline(s)?\b"]
ROLES = {
    "Method": [
        (r"\b(?i:propose[sd]?|introduc(?:e|es|ed|ing)|present[sd]?|develop(?:s|ed)?)\b", "introduces"),
        (r"\b(?i:use[sd]?|using|employ(?:s|ed)?|adopt(?:s|ed)?|appl(?:y|ies|ied))\b", "uses_method"),
    ],
    "Dataset": [(r"\b(?i:evaluat(?:e|es|ed)|train(?:s|ed)?|test(?:s|ed)?|benchmark(?:s|ed)?|use[sd]?|using)\b", "uses_dataset")],
    "Task": [(r"\b(?i:solve[sd]?|address(?:es|ed)?|target(?:s|ed)?|tackle[sd]?|for)\b", "solves_task")],
}
ROLE_EDGES = {"introduces": "INTRODUCES", "uses_method": "USES_METHOD", "uses_dataset": "USES_DATASET", "solves_task": "SOLVES_TASK"}

RELATIONS = {
    ("Method", "Method"): [
        (r"\b(?:improved? upon|outperforms?|better than|superior to|surpasses?|beats?)\b", "IMPROVES_UPON"),
        (r"\b(?:extends?|builds? on|builds? upon|incorporates?|introduces?|proposes?)\b", "EXTENDS"),
        (r"\b(?:variant of|variation of|version of|derivative of)\b", "VARIANT_OF"),
        (r"\b(?:compared? to|compared? with|vs\.?|versus|against)\b", "COMPARES_TO"),
    ],
    ("Method", "Dataset"): [
        (
            r"\b(?:evaluated? on|evaluates? on|tested? on|train(?:ed)? on|benchmark(?:ed)? on|uses?|applied? to|achieves?[^\n]*on)\b",
            "USES_DATASET",
        )
    ],
    ("Method", "Task"): [
        (r"\b(?:solves?|addresses?|designed? for|applied? to|tackles?|target(?:ed)? for|used for)\b", "SOLVES_TASK")
    ],
    ("Dataset", "Task"): [(r"\b(?:benchmark for|dataset for|standard for|used for|created for|evaluated on)\b", "BENCHMARK_FOR")],
    ("Dataset", "Dataset"): [(r"\b(?:compared? to|compared? with|vs\.?|versus|against)\b", "COMPARES_TO")],
    ("Experiment", "Dataset"): [(r"\b(?:evaluates? on|evaluated? on|uses?|tested? on)\b", "EVALUATES_ON")],
    ("Experiment", "Metric"): [(r"\b(?:reports?|achieves?|obtains?|measured by|shows?|yields?)\b", "REPORTS_METRIC")],
}

NODE_TYPES = ["Paper", "Method", "Dataset", "Task", "Metric", "Author", "Institution", "Claim", "Experiment", "Section"]
#: (source type, edge type, target types)
ONTOLOGY = [
    ("Paper", "CITES", ["Paper"]),
    ("Paper", "CITED_BY", ["Paper"]),
    ("Paper", "INTRODUCES", ["Method"]),
    ("Paper", "USES_METHOD", ["Method"]),
    ("Paper", "USES_DATASET", ["Dataset"]),
    ("Paper", "PUBLISHED_DATASET", ["Dataset"]),
    ("Paper", "SOLVES_TASK", ["Task"]),
    ("Paper", "WRITTEN_BY", ["Author"]),
    ("Paper", "HAS_SECTION", ["Section"]),
    ("Paper", "MENTIONS", ["Method", "Dataset", "Task", "Metric"]),
    ("Method", "IMPROVES_UPON", ["Method"]),
    ("Method", "EXTENDS", ["Method"]),
    ("Method", "VARIANT_OF", ["Method"]),
    ("Method", "SOLVES_TASK", ["Task"]),
    ("Method", "USES_DATASET", ["Dataset"]),
    ("Method", "COMPARES_TO", ["Method"]),
    ("Dataset", "BENCHMARK_FOR", ["Task"]),
    ("Dataset", "COMPARES_TO", ["Dataset"]),
    ("Task", "RELATED_TASK", ["Task"]),
    ("Experiment", "EVALUATES_ON", ["Dataset"]),
    ("Experiment", "REPORTS_METRIC", ["Metric"]),
    ("Author", "AFFILIATED_WITH", ["Institution"]),
    ("Section", "CONTAINS_CLAIM", ["Claim"]),
]

QUERY_CLASSES = [
    ("CITATION", [r"\bcite[sd]?\b", r"\bcitation[s]?\b", r"\breference[sd]?\b", r"\bcited by\b", r"\bwho cites\b", r"\bpapers? that cite[s]?\b"]),
    (
        "EVOLUTION",
        [r"\bevolv(e|ed|ing)\b", r"\bevolution\b", r"\bhistory of\b", r"\bover time\b", r"\bprogress(ion|ed)?\b", r"\bdevelopment of\b", r"\bfrom .+ to .+\b"],
    ),
    (
        "COMPARISON",
        [
            r"\bcompar(e|ed|ison|es)\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference[s]? between\b", r"\bbetter than\b", r"\bworse than\b",
            r"\bcompared to\b", r"\boutperform(s|ed|ing)?\b", r"\bimprov(e|ed|es|ing)\s+(on|upon)\b",
        ],
    ),
    (
        "SURVEY",
        [
            r"\bsurvey\b", r"\boverview\b", r"\bstate[- ]of[- ]the[- ]art\b", r"\breview of\b", r"\bsummari[sz]e\b",
            r"\bwhat (?:methods|approaches|techniques) exist\b",
        ],
    ),
    ("ENTITY_LOOKUP", [r"^\s*what is\b", r"^\s*who is\b", r"^\s*define\b", r"\btell me about\b"]),
]
WANTS_VECTOR = ["EXPLANATION", "COMPARISON", "SURVEY"]
WANTS_GRAPH = ["CITATION", "EVOLUTION", "COMPARISON", "SURVEY", "ENTITY_LOOKUP"]

# edges, article, type noun and forbidden values of names
NAME_EDGES = r"^[ \t\r\n,;:.()\[\]{}]+|[ \t\r\n,;:.()\[\]{}]+$"
NAME_ARTICLE = r"(?i)^(?:a|an|the)\s+"
NAME_NOUN = r"(?i)\s+(?:model|method|architecture|framework|algorithm|approach)$"
NO_NAMES = ["method", "dataset", "task", "metric", "claim", "experiment"]
NUMBER_NAME = r"^\d+(?:\.\d+)?$"
NAME_LENGTH = (2, 120)
