"""Regular expressions and word lists.

Everything here is a fixed value: results depend on these exact vocabularies. Patterns avoid
look-around and back-references where a plain alternative exists, and group repetitions over long
arguments are possessive, so they cannot exhaust the regex stack of an executor.
"""

from __future__ import annotations

# one level of nested braces; possessive, so a repetition is a loop and not a recursion
BRACED = r"\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"
BRACED_NC = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"

HEADING = r"\\(?:sub){0,2}section\*?\s*(?:\[[^\]]*\])?" + BRACED_NC
TOKEN = r"[A-Za-z][A-Za-z\-']*|\d+(?:\.\d+)?"
CITE = r"\\[cC]ite[A-Za-z*]*\s*(?:\[[^\]]*\]\s*)*\{([^}]*)\}"
REF_MACRO = r"\\([A-Za-z]*[Rr]ef[A-Za-z]*)\s*((?:\{[^{}]*\}\s*)+)"
REF_BLACKLIST = r"(?i)href|name$|format|stepcounter|Fraction|hyperref|refstyle|prefix|url|newref|labelref|reftitle"
APPENDIX_START = r"(?i)\\appendix\b|\\section\*?\{\s*(?:Appendix|Appendices|Supplementary|Acknowledg)"
APPENDIX_TITLE = (r"(?i)appendix|supplement|acknowledg|implementation details?|additional (?:results?|experiments?|details?|analys)|"
                  r"further (?:results?|details?|analys)|proofs?|derivations?|extended|broader impact|checklist|ethic")
BODY_END = (r"(?i)\\appendix\b|\\section\*?\{\s*Acknowledg|\\begin\{thebibliography\}|\\bibliography\s*\{|"
            r"\\printbibliography|\\end\{document\}")

# ordered: the first matching pattern decides the role of a section title
ROLES = [
    ("Abstract", r"^abstract$"),
    ("Intro", r"^(\d+\.?\s*)?(introduction|intro|overview and motivation|motivation)$"),
    ("Related", r"related|prior work|background|preliminar|literature|previous work|problem setting|notation"),
    ("Method", r"method|approach|framework|model|algorithm|proposed|architecture|formulation|design|technique|theory|"
               r"theoretical|our system|system description|defense|attack"),
    ("Experiments", r"experiment|evaluation|result|empirical|setup|implementation detail|benchmark|study|ablation|"
                    r"training dynamics|analysis|comparison|per-seed|rankings|findings"),
    ("Conclusion", r"conclusion|discussion|limitation|future work|broader impact|ethic|summary"),
    ("Appendix", r"appendix|supplement|proof|additional|hyperparameter|dataset detail|prompt"),
]
SUMMARY_SLOT = r"(?i)conclu|concluding|\bsummary\b|closing remarks|final remarks"
STATEMENT_SLOT = r"(?i)ethic|impact statement|broader impact|societal|reproducibility statement|checklist|acknowledg"

# normalized section names of the citation-role table, ordered
CITE_SECTIONS = [
    ("related_work", r"related|background|prior work|literature|preliminar"),
    ("introduction", r"introduction"),
    ("method", r"method|approach|framework|model|algorithm|proposed|design|system"),
    ("experiments", r"experiment|evaluation|result|empirical|analysis|study|ablation|benchmark"),
    ("conclusion", r"conclusion|discussion|limitation|future"),
]

FLOAT_ENVS = ("figure table algorithm algorithmic wrapfigure wraptable sidewaystable tabular tabularx longtable minipage "
              "tcolorbox lstlisting verbatim Verbatim minted framed mdframed shaded promptbox prompt tikzpicture listing "
              "boxedminipage comment").split()
MATH_ENVS = "equation align gather multline eqnarray displaymath flalign alignat".split()
THEOREM_ENVS = "theorem lemma proposition corollary definition assumption remark".split()
EXHIBIT_ENVS = "verbatim lstlisting minted quoting quote tcolorbox mdframed exampleblock promptbox examplebox".split()
EXHIBIT_CAPTION = (r"(?i)\\caption\{[^{}]{0,160}\b(an example|example of|examples? (?:of|from|where)|case stud\w*|failure case|"
                   r"qualitative (?:example|result|analysis)|sample (?:output|response|generation))\b")
EXHIBIT_QUOTE = r"``[^`']{40,600}''"
EXHIBIT_TITLE = (r"(?i)error analysis|failure (?:analysis|mode|case)|case stud\w*|qualitative analysis|worked example")
PERCENT = r"\d+(?:\.\d+)?\s*\\?%"

STOP_WORDS = ("the a an of and or to in on for with by is are was were be been being this that these those we our it its "
              "as at from than then thus which such can may also more most other each both same very using used use no not all any "
              "into over under between within across per via i e g").split()
SENTINELS = "xxmathxx xxcitexx xxrefxx xxcaptionxx xxverbatimxx".split()

# a full stop after one of these does not end a sentence
ABBREVIATIONS = r"et al|e\.g|i\.e|cf|vs|Fig|Figs|Eq|Eqs|Sec|Secs|Tab|Tabs|resp|approx|no|etc|al|Dr|Prof|w\.r\.t|a\.k\.a|Alg|App"
SENTENCE_START = r"[A-Z0-9(\[\"'“]"

TEXT_SECTION = (r"\b(?:Section|Sections|Sec\.|Secs\.|Appendix|Appendices|App\.|§)\s*~?\s*([A-Z]?\d+(?:\.\d+)*|[A-Z])"
                r"(?:\s*(?:,|and|&)\s*~?\s*([A-Z]?\d+(?:\.\d+)*|[A-Z]))*")

METRIC_LOWER = (r"\b(nll|loss|error|err|brier|ece|rmse|mae|mse|perplexity|ppl|fid|wer|cer|regret|latency|runtime|time|cost|variance|"
                r"deviation|distance|calibration|fpr|fnr|asr|attack success|misaligned|mis|incoherent|inc|toxicity|violation|gap|delta)\b")
METRIC_HIGHER = (r"\b(accuracy|acc|f1|auc|auroc|auprc|precision|recall|ndcg|r@\d+|recall@\d+|map|bleu|rouge|score|iou|dice|success|"
                 r"reward|correlation|spearman|pearson|hit@\d+|mrr|pass@\d+|em|exact match|win rate|coverage|robustness|sharpe|return|ir|calmar)\b")
METHOD_FIGURE = r"(?i)overview|pipeline|architecture|framework|illustrat|workflow|schematic"

# figure transcripts
FIGURE_HEADER = r"(?i)published as a conference paper|preprint|under review|arxiv:\d|^\d+$"
FIGURE_KINDS = {
    "notation_key": r"(?i)^\s*legend\b|\b(solid|dashed|dotted)\s+(arrow|line)s?\s*[:=]|"
                    r"\b(light\s+)?(blue|green|orange|yellow|red|purple|gray|grey|pink)\s*(fill|box(es)?)?\s*[:=]\s*\w|"
                    r"=\s*(data flow|main flow|feedback|repair|conditional)|^\s*(→\s*)?(\w+\s+){0,2}flow\s*$",
    "comparison_arm": r"(?i)\((ours|proposed|baseline|prior|existing)\)|\b(ours|baseline)\s*[:—-]|\bcondition\s+[A-D]\b",
    "evaluative_mark": r"[✓✗✅❌✔✘☑☒]",
    "thesis_box": r"(?i)\b(key (insight|idea|contribution|innovation|advantage)|why (it|this) works|takeaway|novelty)\b",
    "enumerated_stage": r"(?i)^\s*(stage|step|phase)\s*[0-9ivx]+\b",
}
FIGURE_GLOSS = (r"(?i)\b(utiliz\w+|leverag\w+|employ\w+|combin\w+|appl\w+|integrat\w+)\b.{0,120}?\b(to|for)\s+\w+|"
                r"\b(enabl\w+|ensur\w+|mitigat\w+|achiev\w+|improv\w+)\b.{0,80}$")
FIGURE_ORDER = ["notation_key", "comparison_arm", "experimental_content", "evaluative_mark", "thesis_box", "enumerated_stage"]
ENUM_LABEL = r"(?i)\b((?:phase|stage|step|module|layer|part|round|level))\s*[:\-]?\s*(\d{1,2}|[ivx]{1,4})\b"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}

# citation sentences: cues that relate works to each other or to the speaker
SELF = r"(?i)\b(our|we|ours|this work|this paper|the present (work|paper|study))\b"
CUE = (r"(?i)\b(however|unlike|in contrast|by contrast|whereas|while|although|though|differ\w*|rather than|instead of|similar(ly)?( to)?|"
       r"compar(ed|es|ing|able|ison)( to| with)?|both|complement\w*|orthogonal|akin to|analogous|build(s|ing)? (on|upon)|based on|extend(s|ed|ing)?|"
       r"follow(s|ing)?|improv\w+ (on|upon|over)|generali[sz]\w+|in common|share[sd]?|combin\w+|unif\w+|closest to|most (closely )?related|contrary|"
       r"conversely|in line with|consistent with|departs? from|advantage over|limitation|connected to|relat(es|ed) to|relevant to|address\w*|gap|fill|"
       r"bridge|motivat\w+|first to|none|neither)\b")
REL1 = (r"(?i)\b(unlike|in contrast to|compared (to|with)|in comparison (to|with)|similar(ly)? to|as in|akin to|analogous to|build(s|ing)? (up)?on|"
        r"extend(s|ed|ing)? (the|this|these|their|prior|previous|earlier|work|idea|approach|method)|improv\w+ (up)?on|improv\w+ over|"
        r"differ(s|ent|ing)? from|complement(s|ary to|ing)?|orthogonal to|follow(s|ing)? (the|this|their|prior|previous)|inspired by|closely related to|"
        r"generali[sz]\w+ (the|this|their|prior|previous)|(same|similar|different) (idea|approach|spirit|line|principle) (as|to|of|from)|"
        r"in the (same |similar )?(spirit|vein) (of|as)|alternative to|variant of|special case of|instance of|whereas|by contrast|conversely|"
        r"in contrast,|however,? (their|this|these|such))\b")
GROUP = (r"(?i)\b((these|those|both|all|such|existing|prior|previous|current|the above|the aforementioned|most|many|none|neither|each) (of )?(the |these )?"
         r"(\w+[- ])*(methods?|approach(es)?|works?|studies|techniques?|systems?|models?|lines?|efforts?|directions?|frameworks?|strategies|schemes?|benchmarks?)|"
         r"they (all|both|each)|the (former|latter)|(across|between|among) (these|those|them|the two|the three))\b")
ANAPHOR = (r"(?i)\b(this|these|those|that|such) (\w+ )?(task|method|approach|technique|finding|result|line|idea|setting|phenomen\w*|challenge|limitation|gap|"
           r"problem|direction|observation|insight|framework|formulation|assumption|strategy|scheme|model|benchmark|dataset|issue|concern|question)s?\b")
REL1_INIT = (r"(?i)^\W*(similarly|likewise|analogously|in a similar vein|along (this|the same) line|following this|building on this|relatedly|"
             r"complementary to this|in the same spirit)\b")
SYNTH_INIT = (r"(?i)^\W*(in contrast|by contrast|conversely|overall|taken together|collectively|in summary|together,|unlike|whereas|"
              r"however,? (these|those|existing|such|none|all|most|neither|current|prior|previous)|"
              r"(while|although|though|despite) (these|those|such|existing|all|prior|previous))\b")
USES = (r"(?i)\b(we|our \w+) (use|used|adopt|adopted|employ|employed|leverage|leveraged|apply|applied|rely|relied|follow|followed|build|built|base|based|"
        r"take|took|borrow|borrowed|instantiate|evaluate|evaluated|reuse|reused|draw|drew)\b")

# relation claims
CLAIM_KINDS = ["limitation", "comparison", "use", "extension"]
OWN_PHRASE = r"(?i)\b(our|ours|we|this (work|paper|study|approach|method|framework)|the proposed|proposed (method|approach|framework))\b"
PRIOR_CLASS = (r"(?i)\b(prior|previous|existing|past|recent|earlier|current|conventional|traditional|standard|most|many|these|those|other)\s+(\w+[- ]){0,3}"
               r"(works?|methods?|approach(es)?|studies|techniques?|models?|systems?|notions?|efforts?|lines?|attempts?|solutions?|baselines?|literature|"
               r"frameworks?|architectures?|schemes?|linearizing|linearization)\b")
LIMIT_CUE = (r"(?i)\b(fail\w*|cannot|can not|do(es)? not|lack\w*|limited|limitation|insufficient|suboptimal|waste\w*|degrade\w*|ignore\w*|overlook\w*|"
             r"neglect\w*|only|however|but|assum\w+|restrict\w*|require\w*|struggle\w*|unable|expensive|costly|prohibitive|bottleneck|drawback|shortcoming|"
             r"gap|miss\w*|still)\b")
COMPARE_CUE = (r"(?i)\b(unlike|whereas|while|although|though|compar\w*|differ\w*|similar\w*|contrast|than|both|however|but|instead|rather|outperform\w*|"
               r"improv\w*|lag\w*|better|worse|superior|inferior|faster|slower|cheaper|larger|smaller|higher|lower|more|less|same|akin|analogous|versus|vs)\b")

# venue evidence in free-text comments
VENUE_BAD = r"(?i)workshop|findings|tiny paper|non.?archival|rejected|withdraw"
VENUE_WORDS = (r"ICLR|NeurIPS|Neural Information Processing|ICML|International Conference on Machine Learning|ACL\b|"
               r"Association for Computational Linguistics|EMNLP|Empirical Methods in Natural Language|NAACL|COLM|CVPR|"
               r"Computer Vision and Pattern Recognition|ICCV|ECCV|AAAI|IJCAI|AISTATS|KDD|VLDB|SIGIR|SIGMOD|The Web Conference|WWW '?2\d|"
               r"USENIX Security|CCS\b|IEEE S&P|Oakland|TPAMI|Trans[a-z.]* on Pattern Analysis|TMLR|Transactions on Machine Learning Research|"
               r"JMLR|PNAS|Nature\b|Science\b|ICSE|FSE\b|MLSys|COLING|Interspeech|ICASSP")
VENUE_ACCEPTED = (r"(?i)(accept|to appear|appear[s]?|published|camera.?ready|presented|oral|spotlight|poster)[^.;]{0,80}?\b(" + VENUE_WORDS + ")")
VENUE_DATED = r"\b(" + VENUE_WORDS + r")\s*[,;]?\s*(20\d\d|'\d\d)\b"

# contribution type from title (t) and abstract (a), first rule that holds
TYPE_INCOMPATIBLE = [("method", "survey"), ("method", "dataset"), ("method", "benchmark"), ("analysis", "survey"), ("analysis", "dataset"),
                     ("framework", "survey"), ("framework", "dataset")]
TYPE_SURVEY = r"\bsurvey\b|systematic review|literature review"
TYPE_BENCHMARK = r"\bbench(mark)?\b|leaderboard|testbed|evaluation suite|a suite of"
TYPE_DATASET = r"\bdataset\b|\bcorpus\b"
TYPE_NOT_DATASET = r"method|approach|learning"
TYPE_QUESTION = r"^(do|does|are|is|can|why|how|what|when|should)\b|\?$"
TYPE_ANALYSIS = (r"(is|are) (insufficient|not (necessary|enough|sufficient))|does not (improve|help|transfer)|\ban (empirical |systematic )?(study|analysis)\b|"
                 r"understanding\b|investigat|rethinking|revisiting|^on the\b|measuring\b|characteriz|dissect|reveals\b|a case study")
TYPE_FRAMEWORK = r"framework for (evaluat|analy|assess)|evaluation framework|a metric\b|new metric|protocol for"
TYPE_METHOD = r"we (propose|introduce|present|develop|design)"
TYPE_RELEASE = r"we (introduce|present|release|construct|curate)"
