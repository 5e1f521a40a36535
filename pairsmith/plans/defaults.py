"""Prompt templates that a configuration may replace; written for this library."""

TEMPLATES = {
    "subtopics": "List {{.Count}} distinct subtopics of {{.MainTopic}}{{if .Exclude}}, none of them among: {{.Exclude}}{{end}}. Answer with a JSON array of strings only.",
    "prompts": "Write {{.Count}} varied writing tasks about {{.SubTopic}} ({{.MainTopic}}). Answer with a JSON array of strings only.",
    "chosen": "{{.Prompt}}",
    "rejected": "{{.Prompt}}",
    "judge": 'Rate the reply to the task by the criteria {{.Criteria}}, each from 1 to 5. Answer with a JSON object such as {"style": {"score": 3, "reasoning": "..."}}.\nTask: {{.Prompt}}\nReply: {{.Reply}}',
    "judge_filter": 'Score the reply to the task from 1 to 5 by {{.Criteria}}. Answer with a JSON object such as {"style": {"score": 3}}.\nTask: {{.Prompt}}\nReply: {{.Reply}}',
}
CRITERIA = ("plot", "creativity", "development", "character", "emotional", "originality", "pacing", "dialogue", "world", "engagement", "grammar", "adherence")
FILTER_CRITERIA = ("relevance", "quality", "creativity", "coherence", "engagement")
