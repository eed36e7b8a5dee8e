"""Phrases, openings of sentences and structural patterns of seven generators.
A table of the user's own (model, kind, phrase) may stand for them."""

from __future__ import annotations

TEXT = """
gpt-3.5-turbo
phrase: as an ai language model | i don't have personal opinions | it's important to note that | it's worth noting that | keep in mind that | bear in mind that | i should point out | it's also important to | additionally, it's worth | furthermore, it should be | i cannot provide | i'm unable to | i don't have the ability | based on the information | according to the context
starter: however, | additionally, | furthermore, | moreover, | in conclusion, | therefore, | consequently, | as a result, | in summary, | ultimately,
pattern: firstly | secondly | thirdly | on one hand | on the other hand | in terms of | with regard to
gpt-4
phrase: it's important to note that | it's worth mentioning that | to clarify this point | in other words, | that being said, | in essence, | fundamentally, | at its core, | from a broader perspective | when considering | this suggests that | this implies that | it follows that | consequently, | accordingly,
starter: interestingly, | notably, | crucially, | essentially, | ultimately, | significantly, | importantly, | remarkably, | surprisingly,
pattern: in light of | with respect to | pertaining to | as evidenced by | as indicated by | as suggested by
claude-3-opus
phrase: i'd be glad to | i'm happy to help | let me explain this | to clarify this further | in this context, | from this perspective, | building on that point | expanding on this idea | delving deeper into | to elaborate further | it's worth considering | this raises the question | this highlights the importance | this underscores the need
starter: certainly, | indeed, | particularly, | specifically, | notably, | importantly, | interestingly, | crucially,
pattern: in other words | to put it differently | that is to say | for instance | for example | as an illustration
gemini-pro
phrase: here's what you need to know | here's how it works | let's explore this | let's look at this | consider this example | think of it this way | imagine if you will | picture this scenario | to break it down | in simple terms | put simply, | basically, | the key point is | the main idea here
starter: now, | so, | well, | basically, | essentially, | actually, | technically, | practically,
pattern: on that note | speaking of which | by the way | as a side note | incidentally | in any case
llama-3
phrase: it's worth noting | it's important to understand | this means that | this indicates that | this shows that | this demonstrates that | based on this, | given this context | in this case, | for this reason | as such, | therefore,
starter: first, | second, | third, | next, | then, | finally, | overall, | in general,
pattern: in addition | moreover | furthermore | however | nevertheless | nonetheless
deepseek-chat
phrase: i understand you're asking | let me help you with that | i can assist you with | regarding your question | to answer your question | in response to your query | based on your request | as per your question | concerning your inquiry | with respect to your question | i'll do my best to | i'll try to help you | allow me to explain | let me break it down
starter: well, | okay, | so, | now, | first, | actually, | specifically, | generally,
pattern: in other words | to put it simply | that is | for example | for instance | such as
mixtral
phrase: it should be noted that | it is important to recognize | this suggests that | this implies that | this indicates that | from this we can see | based on this analysis | considering these points | taking into account | in light of these factors
starter: however, | moreover, | furthermore, | additionally, | conversely, | similarly, | likewise,
pattern: on the one hand | on the other hand | in contrast | by comparison | as opposed to | rather than
"""


def rows() -> list[tuple[str, str, str]]:
    """(model, kind, phrase)."""
    out, model = [], ""
    for line in filter(None, TEXT.split("\n")):
        kind, colon, phrases = line.partition(": ")
        if not colon:
            model = line
        else:
            out += [(model, kind, p) for p in phrases.split(" | ")]
    return out
