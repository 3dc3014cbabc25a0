"""Schemas of the record types."""

from __future__ import annotations

TOKEN = "struct<token_index:int,logprob:double,entropy:double>"
STEP = "struct<start_token:int,end_token:int,mean_entropy:double,max_entropy:double,min_entropy:double,std_entropy:double>"
CANDIDATE = f"struct<reasoning_text:string,predicted_answer_raw:string,predicted_answer_normalized:string,tokens:array<{TOKEN}>,steps:array<{STEP}>>"
CLEANED = "dataset string, sample_id string, question string, answer_raw string, answer_normalized string, split string, metadata map<string,string>"
SAMPLE = f"{CLEANED}, candidates array<{CANDIDATE}>"
PATH = "sample_id string, dataset string, split string, candidate_index int, reasoning_text string, predicted_answer_raw string, predicted_answer_normalized string"
ENTROPY = "sample_id string, dataset string, split string, candidate_index int, token_index int, logprob double, entropy double"
DIRECT = "sample_id string, direct_answer string, direct_prediction_raw string, direct_response string, _prompt_mode string"
PREDICTION = "question_norm string, candidate_role string, true_label string, pred_label string, generated_text string"
MESSAGES = "id string, messages array<struct<role:string,content:string>>, metadata map<string,string>"
