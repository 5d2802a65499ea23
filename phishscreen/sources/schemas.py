"""Schemas of the tables."""

MESSAGES = "msg_key string, header_message_id string, source_path string, label string, received_at timestamp, meta_subject string, meta_author string, headers map<string,array<string>>, bodies array<struct<content_type:string,body:string>>, parse_error string"
EVAL_RECORD = "key string, label string, localScore int, jevScore int, finalScore int, detail map<string,double>, pretext string, fromDomain string, subject string, usage struct<input_tokens:bigint,output_tokens:bigint>, error string"
