"""Schemas of the tables that the operators exchange. A missing string is "" and not null."""

PAGES = "source_file string, page_number int, raw_text string"
PAGE_CACHE = "source_file string, page_number int, strategy string, text string"
BLOCKS = "source_file string, start_page int, start_line int, question_header string, content_lines array<string>, full_content string"
OPTION = "struct<pos:int,letter:string,text:string>"
QUESTIONS = (
    "unique_id string, original_number string, description string, options array<struct<pos:int,letter:string,text:string>>, "
    "community_answer string, highly_voted_answer string, most_recent_answer string, llm_answer string, llm_reasoning string, "
    "latest_date string, topic string, page_number int, confidence_score double, source string, raw_content string, "
    "source_pdf_path string, introductory_info string, has_llm_answer boolean, start_line int"
)
COMMENTS = (
    "question_id string, username string, content string, timestamp string, vote_count int, vote_type string, page_number int, source string"
)
ISSUES = (
    "question_id string, issue_type string, severity string, description string, expected string, actual string, page_number int, confidence double"
)
RESPONSES = "question_id string, response_text string, error string"
ERRORS = "timestamp string, error_type string, error_message string, context string, traceback string, severity string, recoverable boolean"
#: The keys of the web document.
WEB_QUESTION = (
    "struct<id:string,number:string,description:string,options:map<string,string>,"
    "answers:struct<community:string,highly_voted:string,most_recent:string,claude:string>,claude_reasoning:string,"
    "metadata:struct<topic:string,page:int,source:string,date:string,confidence:double>>"
)
WEB = (
    "metadata struct<generated_at:string,total_questions:int,version:string>, "
    "filters struct<topics:array<string>,sources:array<string>,answer_options:array<string>>, "
    f"questions array<{WEB_QUESTION}>"
)
UPDATES = "id string, number string, description string, options map<string,string>, metadata map<string,string>"
